"""Whitening, source divergence and the merge automaton against brute force, with nulls, empty and long texts, ties and clashing names."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave.llm import automaton, bpe, catalog, divergence, inertia, whitening

# -- inertia and whitening ---------------------------------------------------


def _matrices():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 9, 24):
        a = rng.normal(size=(n, n))
        yield a @ a.T
        yield a + a.T
        yield np.eye(n) * 3
        yield np.zeros((n, n))
        yield np.diag(np.r_[np.ones(n // 2) * 5, np.arange(n - n // 2)])
        q, _ = np.linalg.qr(a)
        yield q @ np.diag(np.r_[7.0, 7 + 1e-13, 7 + 1e-8, np.zeros(n)][:n]) @ q.T


def test_counts_and_eigenpairs():
    rng = np.random.default_rng(4)
    for a in _matrices():
        ref = np.sort(np.linalg.eigvalsh((a + a.T) / 2))[::-1]
        size = max(1.0, np.abs(a).max())
        for shift in rng.normal(size=4) * size:
            assert inertia.count_above(a, shift) == (ref > shift).sum()
        values, vectors = inertia.leading_eigenpairs(a, 8)
        assert np.abs(values - ref[:8]).max() < 1e-12 * size * len(a)
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
        assert np.abs(a @ vectors - vectors * values).max() < 1e-11 * size


@pytest.fixture(scope="module")
def embeddings(spark):
    rng = np.random.default_rng(8)
    rows = [(k, [float(np.float32(v)) for v in rng.normal(0, 0.2, 10)], 7, 0.5) for k in range(240)]
    rows += [rows[3], (500, None, 1, 1.0), (501, [1.0, None, *[0.0] * 8], 1, 1.0), (502, [float("nan"), *[0.0] * 9], 1, 1.0), (503, [float("inf"), *[0.0] * 9], 1, 1.0), (None, rows[5][1], None, None)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int, component double"), rows


def _check_whitened(got, rows, dims, components=8):
    good = [(i, v) for i, v, *_ in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100000 for c in v] for _, v in good], object)
    n, s = len(x), x.sum(axis=0)
    centred = (n * x - s).astype(float) / n
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    want = centred @ vectors / np.sqrt(values)
    by_id = defaultdict(list)
    for r in got:
        by_id[r.vec_id].append(r)
    assert len(got) == n * len(values)
    signs = None
    for (i, _), w, dev in zip(good, want, ((n * x - s) ** 2).sum(axis=1), strict=True):
        per = by_id[i]
        for c in range(len(values)):
            mine = [r for r in per if r.component == c + 1]
            assert mine and all(int(r.deviation) == dev and r.n == n for r in mine)
            assert abs(mine[0].explained - values[c] / np.trace(cov)) < 1e-12
        row = np.array([next(r.whitened for r in per if r.component == c + 1) for c in range(len(values))])
        signs = np.sign(row * w) if signs is None else signs
        assert np.abs(row - signs * w).max() < 1e-8
    assert max(r.identity_error for r in got) < 1e-10


def test_whitening(embeddings):
    df, rows = embeddings
    _check_whitened(whitening.whiten(df).collect(), rows, 10)
    _check_whitened(whitening.whiten(df.repartition(7), 3).collect(), rows, 10, 3)


def test_whitening_sums_are_exact_for_large_entries(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(np.float32(v)) for v in rng.normal(0, 1e5, 4)]) for k in range(50)]
    _check_whitened(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect(), rows, 4)


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, []), (2, [])], schema)).count() == 0
    flat = spark.createDataFrame([(k, [float(k), 5.0]) for k in range(4)], schema)
    assert {r.component for r in whitening.whiten(flat).collect()} == {1}
    with pytest.raises(Exception, match="differ in length"):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], schema)).count()


# -- source divergence ---------------------------------------------------------
DOCS = "doc_id long, text string, lang string, source string, term string, n long, value double, item string, held int"


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(6)
    words = ["".join(r.choice("abcé") for _ in range(r.randrange(1, 4))) for _ in range(40)]
    rows = []
    for k in range(160):
        text = " ".join(r.choice(words[: 10 + k % 30]).upper() if k % 5 == 0 else r.choice(words[: 10 + k % 30]) for _ in range(r.randrange(0, 30)))
        rows.append((k, text, r.choice(["en", "de", None]), r.choice(["s1", "s2", "Ünï", "s10", None]), "x", 1, 0.1, "y", 2))
    rows += [rows[0], (None, None, "en", "only nulls", None, None, None, None, None), (7, "", None, None, None, None, None, None, None)]
    rows += [(900, "a" * 70000 + " b,b;B 日本語 b2b", "en", "s1", None, 0, 0.0, "", 0)]
    rows += [(901 + k, f"w{k} rare", "xx", f"s{k}", None, 0, 0.0, "", 0) for k in range(2)]  # a language that keeps no term
    return rows


def _brute_audit(rows, least, top):
    p_of = lambda c, n, v: 1 + 10**9 * (c + 1) // (n + v)
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source, *_ in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = {t for t in df if df[t] >= least}
        count = {s: Counter(t for d in mine if d[1] == s for t in d[2] if t in kept) for s in {d[1] for d in mine}}
        total = sum(count.values(), Counter())
        v, f = len(kept), lambda p, q: (p - q) ** 2 // q
        prob = {s: {t: p_of(c[t], sum(c.values()), v) for t in kept} for s, c in count.items()}
        base = {t: p_of(total[t], sum(total.values()), v) for t in kept}
        for s in count:
            pairs = [(sum(f(prob[s][t], prob[o][t]) for t in kept), o) for o in count if o != s]
            terms = [(f(prob[s][t], base[t]), t) for t in kept if count[s][t] > 0 and prob[s][t] > base[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(found, 1) if part == "pair" or rank <= top}
    return out


@pytest.mark.parametrize(("top", "held"), [(200, None), (7, 5)])
def test_audit(spark, corpus, top, held, monkeypatch):
    if held:
        monkeypatch.setattr(divergence, "HELD_TERMS", held)
    rows = divergence.audit(spark.createDataFrame(corpus, DOCS).repartition(3), top=top).collect()
    got = [(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in rows]
    assert len(got) == len(set(got)) and set(got) == _brute_audit(corpus, 3, top)


def test_audit_equals_its_sql(spark, corpus, tmp_path):
    con = duckdb.connect()
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(corpus, DOCS).repartition(2).write.parquet(path)
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    rows = [tuple(r) for r in catalog.op12_source_divergence(spark, str(tmp_path)).collect()]
    assert sorted(rows) == sorted(con.execute(catalog.OP12_SQL).fetchall())


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0


def test_probability_beyond_a_long(spark):
    counts = [(0, 10, 5), (9_300_000_000, 20_000_000_000, 7), (4_611_686_017, 9_000_000_000, 1), (4_611_686_019, 9_000_000_000, 1)]
    got = spark.createDataFrame(counts, "c long, t long, v long").select(divergence.probability("c", "t", "v").alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (c + 1) // (t + v) for c, t, v in counts]


# -- merge automaton -----------------------------------------------------------


def _apply_merges(word, labels, merges):
    """Merges one after the other, each from left to right."""
    of = {v: k for k, v in labels.items()}
    seq = [of[bytes([b])] for b in word]
    for u, v in merges:
        out = []
        for t in seq:
            if out and out[-1] == u and t == v:
                out[-1] = -1
            else:
                out.append(t)
        seq = [of[labels[u] + labels[v]] if t == -1 else t for t in out]
    return seq


def _random_merges(r, n):
    labels = {b: bytes([b]) for b in range(256)}
    merges, seen = [], set(labels.values())
    while len(merges) < n:
        u, v = (r.choice([97, 98, 99, *range(256, len(labels))]) for _ in range(2))
        if labels[u] + labels[v] not in seen:
            seen.add(labels[u] + labels[v])
            labels[len(labels)] = labels[u] + labels[v]
            merges.append((u, v))
    return labels, merges


@pytest.mark.parametrize("seed", range(12))
def test_automaton_equals_merging_in_order(seed, monkeypatch):
    r = random.Random(seed)
    labels, merges = _random_merges(r, 14)
    machine = automaton.MergeAutomaton(labels, merges)
    if seed % 3 == 0:
        monkeypatch.setattr(automaton, "MOST_STATES", 3)
    for _ in range(150):
        word = bytes(r.choice(b"abc") for _ in range(r.randrange(0, 14)))
        want = _apply_merges(word, labels, merges)
        assert machine.encode_word(word) == want
        assert machine.accepts(want)
        # No other cut of the word is accepted.
        for _ in range(5):
            other = [t for p in _cut(r, word) for t in [next((k for k, v in labels.items() if v == p), None)]]
            assert None in other or other == want or not machine.accepts(other)


def _cut(r, word):
    out, at = [], 0
    while at < len(word):
        n = r.randrange(1, 5)
        out.append(word[at : at + n])
        at += n
    return out


def test_automaton_refuses_other_merge_lists():
    labels = {b: bytes([b]) for b in range(256)} | {256: b"ab"}
    with pytest.raises(ValueError):
        automaton.MergeAutomaton(labels, [(97, 98), (97, 98)])
    with pytest.raises(ValueError):
        automaton.MergeAutomaton({97: b"a"}, [])


def _tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_ids_equal_the_library(monkeypatch):
    store, plain, r = automaton._compiled(bpe.default_path()), _tokenizer(), random.Random(9)
    parts = [" ", "  ", "\n", "\t", "a", "it's", "'ll", "'LL", "éa", "1", ".", "!!", "\xa0", "　", "\x1c", "\x85", "\r\n", "日本", "word", "<|endoftext|>", "<|endoftext", "aaaaaaaaa", "😀", " Th", "½", "é"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(30))) for _ in range(600)]
    for text, raw in zip(texts, automaton._encode_all(texts, store), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    # Words longer than the table may grow, and without any repetition.
    monkeypatch.setattr(automaton, "MOST_STATES", 50)
    long = "".join(chr(97 + r.randrange(26)) for _ in range(5000))
    assert np.frombuffer(automaton._encode_all([long], store)[0], "<u4").tolist() == plain.encode(long).ids
    store["automaton"].forget()


def test_round_trip(spark):
    plain = _tokenizer()
    texts = [None, "", "Hello  world\n\n", "<|endoftext|>", "a <|endoftext|> b", "x" * 30000, "ab " * 20000, "naïve 日本 😀", " \t "]
    rows = [(k, t, "clash", b"z", 3) for k, t in enumerate(texts)] + [(2, texts[2], None, None, None), (None, "no id", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string, ids binary, n_tokens int").repartition(2)
    got = automaton.round_trip(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    want = {i: t or "" for i, t, *_ in rows}
    for r in got:
        ids = plain.encode(want[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded == plain.decode(ids, skip_special_tokens=False) == want[r.doc_id]
    again = {(r.doc_id, r.text) for r in automaton.decode(automaton.encode(docs)).collect()}
    assert again == {(i, t) for i, t in want.items()}
    assert automaton.round_trip(docs.limit(0)).count() == 0
    assert automaton.decode(spark.createDataFrame([(1, None)], "doc_id long, ids binary")).collect()[0].text == ""


def test_digests_of_the_query(spark, tmp_path):
    spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in catalog.op13_bpe_automaton(spark, str(tmp_path)).collect()}
    ids = np.array(_tokenizer().encode("some text").ids, "<u4").tobytes()
    assert got[1].ids_sha256 == hashlib.sha256(ids).hexdigest() and got[1].decoded_sha256 == hashlib.sha256(b"some text").hexdigest()
    assert got[2].n_tokens == 0 and got[2].ids_sha256 == got[2].decoded_sha256 == hashlib.sha256(b"").hexdigest()


def test_extra_columns_do_not_clash(spark, embeddings):
    df, _ = embeddings
    assert set(whitening.whiten(df.withColumn("v", F.lit(1)).withColumn("whitened", F.lit("x"))).columns) >= {"vec_id", "component", "whitened"}
