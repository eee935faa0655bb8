"""Benchmark decontamination: rare word n-grams of test items find passages, local alignment scores them.

Of each item the n-grams that fewest documents hold are its seeds.  A seed found in a document
gives a diagonal; the words around it are aligned with the item by Smith-Waterman, so edited
copies score high and chance matches low.  Items are worked off in blocks of a fixed size, one pass
over the documents each, so neither driver nor task ever holds more than one block.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.durable import cut_lineage
from gridweave.llm.common import Columns, id_text, map_columns, per_row

N = 3
# Share of an item's n-grams, the rarest first, that serve as seeds.
SEED_SHARE = 0.75
MIN_SCORE = 0.5
# Words by which a passage may be longer or shorter than the item on either side of a seed.
SLACK = 10
# Characters of items that one pass over the documents carries; more items are taken in further passes.
BLOCK_CHARS = 4_000_000
# Items of fewer than N words, as of scripts without spaces, are compared by characters if they have so many, and must agree
# closer, as chance alignments of characters score higher.
MIN_CHARS, MIN_CHAR_SCORE = 12, 0.8
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5

_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def chars_of(text: str) -> list[str]:
    """Letters and digits one by one."""
    return [c for c in text.lower() if c.isalnum()]


def align(item: list[str], passage: list[str]) -> tuple[float, int, int]:
    """Best local alignment: its score and the words of ``passage`` it begins at and ends before."""
    best, begin, end = 0.0, 0, 0
    above = [(0.0, j) for j in range(len(passage) + 1)]
    for a in item:
        row = [(0.0, 0)]
        left = (0.0, 0)
        for j, b in enumerate(passage):
            diagonal, up = above[j], above[j + 1]
            score, start = diagonal[0] + (MATCH if a == b else MISMATCH), diagonal[1]
            if up[0] + GAP > score:
                score, start = up[0] + GAP, up[1]
            if left[0] + GAP > score:
                score, start = left[0] + GAP, left[1]
            left = (score, start) if score > 0 else (0.0, j + 1)
            if score > best:
                best, begin, end = score, start, j + 1
            row.append(left)
        above = row
    return best, begin, end


def _grams(words: list[str]) -> Iterator[tuple]:
    return zip(*(words[k:] for k in range(N)), strict=False)


class Matcher:
    """The seeds and words of one block of items; its size is bounded by ``BLOCK_CHARS``."""

    def __init__(
        self, items: list[tuple[int, list[str]]], seeds: dict[tuple, list[tuple[int, int]]], tokens: Callable[[str], list[str]] = words_of, least: float = 0.0
    ):
        self.items, self.seeds, self.keys, self.tokens, self.least = items, seeds, frozenset(seeds), tokens, least

    def find(self, text: str, min_score: float, first_only: bool = False) -> list[tuple]:
        """(item_id, score, start, end, seed hits) of every item with a passage that scores enough; places count tokens."""
        words, min_score = self.tokens(text), max(min_score, self.least)
        hits = self.keys.intersection(_grams(words))
        if not hits:
            return []
        around: dict[int, list[tuple[int, int]]] = {}
        for i, g in enumerate(_grams(words)):
            if g in hits:
                for item, j in self.seeds[g]:
                    size = len(self.items[item][1])
                    around.setdefault(item, []).append((i - j - SLACK, i - j + size + SLACK))
        out = []
        for item, spans in around.items():
            own = self.items[item][1]
            enough, best, seen = min_score * len(own), (0.0, 0, 0), -1
            spans.sort()
            merged: list[list[int]] = []
            for a, b in spans:
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([max(0, a), b])
            for a, b in merged:
                passage = words[a:b]
                # Each word of the item matches at most once, so this bounds the score.
                if sum(map(set(passage).__contains__, own)) * MATCH < enough:
                    continue
                score, begin, end = align(own, passage)
                if score > best[0]:
                    best = (score, a + begin, a + end)
            if best[0] >= enough and best[0] > 0:
                out.append((self.items[item][0], best[0] / len(own), best[1], best[2], len(spans)))
                if first_only:
                    break
        return out


class Blocks:
    """Items in blocks; going through it makes one block's matchers after the other: for words, and for characters if it has such items."""

    def __init__(self, docs: DataFrame, items: DataFrame, n_blocks: int, text_col: str, share: float):
        self.docs, self.items, self.n_blocks, self.text_col, self.share = docs, items, n_blocks, text_col, share

    def __iter__(self) -> Iterator[list[Matcher]]:
        block = F.pmod(F.xxhash64("item_id", "text"), F.lit(self.n_blocks))
        for b in range(self.n_blocks):
            rows = self.items.where(block == b).orderBy("item_id", "text").collect()  # about BLOCK_CHARS characters
            words = [(r["item_id"], words_of(r["text"])) for r in rows]
            by_words = [p for p in words if len(p[1]) >= N]
            short = [(r["item_id"], chars_of(r["text"])) for r, (_, w) in zip(rows, words, strict=True) if len(w) < N]
            by_chars = [p for p in short if len(p[1]) >= MIN_CHARS]
            yield [
                _matcher(self.docs, parts, self.text_col, self.share, tokens, least)
                for parts, tokens, least in ((by_words, words_of, 0.0), (by_chars, chars_of, MIN_CHAR_SCORE))
                if parts
            ]


def matchers(docs: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", doc_text_col: str = "text", share: float = SEED_SHARE) -> Blocks:
    """The matchers of ``items``, block by block.

    Items of fewer than three words are compared by characters; those of fewer than ``MIN_CHARS`` characters too hold
    too little to tell a copy from chance and match nothing, as do null texts.
    """
    given = items.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chars = given.agg(F.sum(F.length("text"))).first()[0] or 0
    return Blocks(docs, given, -(-chars // BLOCK_CHARS) or 1, doc_text_col, share)


def _matcher(docs: DataFrame, items: list[tuple[int, list[str]]], text_col: str, share: float, tokens: Callable[[str], list[str]], least: float) -> Matcher:
    grams = sorted({g for _, w in items for g in _grams(w)})
    place = {g: i for i, g in enumerate(grams)}

    def held(given: Columns) -> Columns:
        tally: dict[int, int] = {}
        keys = place.keys()
        for text in given["text"]:
            for g in keys & set(_grams(tokens(text))):
                tally[place[g]] = tally.get(place[g], 0) + 1
        return {"gram": list(tally), "docs": list(tally.values())}

    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = map_columns(texts, per_row(held), "gram int, docs long").groupBy("gram").agg(F.sum("docs").alias("docs"))
    frequency = {r["gram"]: r["docs"] for r in counted.collect()}  # at most one row per n-gram of the block
    seeds: dict[tuple, list[tuple[int, int]]] = {}
    for k, (_, words) in enumerate(items):
        own = list(_grams(words))
        # The rarest n-grams, however many documents hold them: a passage that a third of all documents copy keeps its seeds.
        order = sorted(range(len(own)), key=lambda j: (frequency.get(place[own[j]], 0), j))
        for j in order[: max(1, math.ceil(len(own) * share))]:
            seeds.setdefault(own[j], []).append((k, j))
    return Matcher(items, seeds, tokens, least)


def _matches(docs: DataFrame, block: list[Matcher], min_score: float) -> DataFrame:
    def rows(given: Columns) -> Columns:
        out: Columns = {k: [] for k in ("doc_id", "item_id", "score", "start_word", "end_word", "seed_hits")}
        for doc, text in zip(given["doc_id"], given["text"], strict=True):
            for m in block:
                for found in m.find(text, min_score):
                    for k, v in zip(out, (doc, *found), strict=True):
                        out[k].append(v)
        return out

    return map_columns(docs, per_row(rows), "doc_id long, item_id long, score double, start_word long, end_word long, seed_hits long")


def matches(docs: DataFrame, blocks: Blocks, id_col: str = "doc_id", text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """``doc_id, item_id, score, start_word, end_word, seed_hits`` of each document and item that match.

    The score is the alignment score over the number of words of the item (of characters, for an item compared by
    them, which then are also what places count).  Whole texts are read; null and empty texts match nothing;
    repeated rows match each; empty tables give an empty result.  With more than one block each one's result is written before the next begins.
    """
    given, out = id_text(docs, id_col, text_col), None
    for block in blocks:
        part = _matches(given, block, min_score)
        part = part if blocks.n_blocks == 1 else cut_lineage(part)
        out = part if out is None else out.unionByName(part)
    return out


def contaminated(block: list[Matcher] | Blocks, text_col: str = "text", min_score: float = MIN_SCORE) -> Column:
    """Whether a text holds a passage of any item of one block; false for null.  ``clean`` goes through many blocks."""
    if isinstance(block, Blocks):
        if block.n_blocks > 1:
            raise ValueError("one column holds one block; use clean")
        block = next(iter(block))

    def flags(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([bool(t) and any(m.find(t, min_score, True) for m in block) for t in texts], dtype=bool)

    return F.pandas_udf(flags, "boolean")(F.col(text_col))


def clean(docs: DataFrame, blocks: Blocks, text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` without a passage of any item; with more than one block what is left is written after each."""
    for block in blocks:
        docs = docs.where(~contaminated(block, text_col, min_score))
        if blocks.n_blocks > 1:
            docs = cut_lineage(docs)
    return docs
