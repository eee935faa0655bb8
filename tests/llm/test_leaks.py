"""Benchmark passages: whole items against all documents by plain alignment, items without spaces, many blocks."""

import random

import pytest

from gridweave.llm import decontaminate as dc


def _plain_score(item, words):
    """Smith-Waterman over the whole text, as a table."""
    best = 0.0
    above = [0.0] * (len(words) + 1)
    for a in item:
        row = [0.0]
        for j, b in enumerate(words):
            row.append(max(0.0, above[j] + (dc.MATCH if a == b else dc.MISMATCH), above[j + 1] + dc.GAP, row[j] + dc.GAP))
        best = max(best, *row)
        above = row
    return best / len(item)


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdefghijk") for _ in range(5)) for _ in range(900)]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(k, say(r.randrange(8, 40))) for k in range(12)]
    docs = []
    for k in range(90):
        words = say(r.randrange(5, 120))
        if k % 3 == 0:
            passage = list(r.choice(items)[1])
            for _ in range(r.randrange(0, len(passage) // 2 + 1)):  # edits: changed, dropped and added words
                at = r.randrange(len(passage))
                passage[at : at + r.randrange(2)] = r.choice([[], say(1), say(2)])
            at = r.randrange(len(words))
            words[at:at] = passage
        docs.append((k, " ".join(words).capitalize() + "."))
    docs += [(200, None), (201, ""), docs[0]]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items] + [(50, None), (51, "two words"), (52, "")], "item_id long, text string")
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), bench, dict(docs), dict(items)


def test_recall_against_all_pairs(tables):
    docs, bench, texts, items = tables
    got = {(r.doc_id, r.item_id): r.score for r in dc.matches(docs, dc.matchers(docs, bench)).collect()}
    want = {}
    for d, text in texts.items():
        words = dc.words_of(text or "")
        for i, item in items.items():
            score = _plain_score(item, words)
            if score >= dc.MIN_SCORE:
                want[d, i] = score
    assert len(want) > 20 and set(got) <= set(want)
    assert len(got) >= 0.9 * len(want)
    # A passage that is found may be cut off at its slack, never scored higher.
    assert all(s <= want[k] + 1e-9 for k, s in got.items())


def test_many_blocks_give_the_same(tables, monkeypatch):
    docs, bench, _, _ = tables
    one = dc.matchers(docs, bench)
    whole = sorted(tuple(r) for r in dc.matches(docs, one).collect())
    kept = sorted(r.doc_id for r in dc.clean(docs, one).collect())
    monkeypatch.setattr(dc, "BLOCK_CHARS", 300)
    many = dc.matchers(docs, bench)
    assert many.n_blocks > 3
    assert sorted(tuple(r) for r in dc.matches(docs, many).collect()) == whole
    assert sorted(r.doc_id for r in dc.clean(docs, many).collect()) == kept
    found = {r[0] for r in whole}
    assert kept == sorted(d for d in [r.doc_id for r in docs.collect()] if d not in found)
    with pytest.raises(ValueError):
        dc.contaminated(many)


def test_items_without_spaces(spark):
    item = "床前明月光疑是地上霜举头望明月低头思故乡啊啊"
    bench = spark.createDataFrame([(1, item), (2, "短句"), (3, "x")], "item_id long, text string")
    rows = [(1, f"前言。{item}。后记"), (2, item[:9] + "，" + item[9:]), (3, item[:6] + "别的文字在这里"), (4, "短句 x"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.matches(docs, dc.matchers(docs, bench)).collect()}
    assert got == {(1, 1), (2, 1)}
    assert {r.doc_id for r in dc.clean(docs, dc.matchers(docs, bench)).collect()} == {3, 4, 5}


def test_long_texts(spark):
    r = random.Random(2)
    words = [f"w{r.randrange(5000)}" for _ in range(40000)]
    item = " ".join(f"q{k}" for k in range(20))
    docs = spark.createDataFrame([(1, " ".join([*words, item, *words])), (2, " ".join(words))], "doc_id long, text string")
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    got = dc.matches(docs, dc.matchers(docs, bench)).collect()
    assert [(x.doc_id, x.item_id, x.start_word, x.end_word, x.score) for x in got] == [(1, 9, 40000, 40020, 1.0)]
    assert dc.matches(docs, dc.matchers(docs, bench.limit(0))) is not None
