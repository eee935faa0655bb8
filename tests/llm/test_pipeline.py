"""The pipeline's stages one by one, and the whole against a brute-force run over the same small tables."""

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from gridweave.llm import bpe, packing, quality, secret_spans

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(13)
    words = "lorem ipsum dolor sit amet tempor magna elit sed labore aliqua minim veniam quis nostrud".split()
    vocabulary = words + [w + s for w in words for s in ("us", "a", "em")]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n)) + "."
    passage = " ".join(f"bench{k}" for k in range(18))
    texts = {}
    for k in range(120):
        texts[k] = (say(60).upper() + "!!" * 20) if k % 4 == 0 else say(60) + " " + say(30)
    texts[1] = texts[2] + " extra"  # a near copy
    texts[3] = texts[2]  # an exact one
    texts[5] = f"{say(40)} {passage} {say(20)}"
    texts[6] = say(50) + ' token = "f3ef4d6b2755a36d7d9c25bd72c4d5f6" ' + say(20)
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in texts.items()]
    rows += [(200, None, None, None, None), (201, "", "en", "s", 0), (None, say(80), "en", "s", 1), (7, say(70), "en", "s", 1), (7, say(70), "de", "s", 2)]
    out = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    """Each stage's rows, and the rows it was given."""
    docs, out, kept = spark.read.parquet(f"{folder}/documents.parquet"), [], tmp_path_factory.mktemp("stages")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{kept}/{k}")
        given, docs = docs, spark.read.parquet(f"{kept}/{k}")
        out.append((name, given.collect(), docs.collect()))
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == [n for n, _, _ in stages]
    assert all(set(rows[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars"} for _, _, rows in stages[:-1])


def test_quality_stage(spark, stages):
    _, given, kept = stages[0]
    ids = {r.doc_id for r in kept}
    good = {k for k in range(120) if k % 4}
    assert len(good - ids) <= 2 and len(ids & {k for k in range(120) if k % 4 == 0}) <= 2
    assert not ids & {200, 201}
    docs = spark.createDataFrame(given, SCHEMA)
    scored = quality.score(docs, quality.train(docs, spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(90)], "doc_id long, quality int")))
    assert Counter(r.doc_id for r in kept) == Counter(r.doc_id for r in scored.where("kept").collect())


def _shingles(text):
    words = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_duplicate_stage(stages):
    _, given, kept = stages[1]
    ids = Counter(r.doc_id for r in kept)
    assert ids[2] == 0 or ids[1] == 0
    assert ids[3] == 0 and ids[1] == 1 and ids[2] == 0  # the smallest id of the group stays
    assert ids[7] == 1 and ids[None] == 1
    sets = [_shingles(r.text) for r in kept]
    for i in range(len(sets)):
        for j in range(i):
            assert kept[i].doc_id is None or kept[j].doc_id is None or 100 * len(sets[i] & sets[j]) < 75 * len(sets[i] | sets[j])
    assert sum(ids.values()) == len(given) - 4  # two of the three rows of an id, and two copies


def test_one_row_of_an_id_is_always_the_same(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id = 7")
    seen = {tuple(corpus_pipeline.near_duplicate_stage(spark, docs.repartition(n), folder).where("doc_id = 7").collect()) for n in (1, 2, 3)}
    assert len(seen) == 1


def test_decontamination_stage(stages):
    _, given, kept = stages[2]
    assert {r.doc_id for r in given} - {r.doc_id for r in kept} == {5} and len(kept) == len(given) - 1


def test_secret_stage(stages):
    _, given, kept = stages[3]
    before, after = {r.doc_id: r.text for r in given}, {r.doc_id: r for r in kept}
    assert set(before) == set(after) and len(given) == len(kept)
    for k, r in after.items():
        assert r.n_chars == len(r.text)
        assert (r.text == before[k]) == (not secret_spans.base_spans(before[k]))
    assert "[SECRET]" in after[6].text and "f3ef4d" not in after[6].text


def test_packing_stage(stages):
    _, given, pieces = stages[4]
    store = bpe.lookups(bpe.default_path())
    whole = {r.doc_id: [*np.frombuffer(bpe.encode(r.text, store), "<u4").tolist(), 0] for r in given}
    got = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id is None, p.doc_id or 0, p.start)):
        assert p.start == len(got.setdefault(p.doc_id, []))
        got[p.doc_id] += list(p.ids)
    assert got == whole
    windows = {}
    for p in pieces:
        windows.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW


def test_run_and_empty_tables(spark, folder, tmp_path, stages):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert Counter(r.doc_id for r in rows if r.start == 0) == Counter(r.doc_id for r in stages[4][2] if r.start == 0)
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
