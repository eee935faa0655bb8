"""Token counts that follow edits: a segment tree over blocks of pre-tokens per document.

A tree is two arrays of leaf values (characters and tokens per block) beside the text; inner
sums are rebuilt in memory.  An edit re-encodes from the start of the first block it touches
until a block boundary is met again, and adds the differences up the tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm import bpe
from gridweave.llm.common import Columns, id_text, map_columns, per_row

BLOCK = 64
# Texts whose unseen words are encoded in one call.
TOGETHER = 64


class CountTree:
    """Sums of characters and tokens over the leaves of one document."""

    def __init__(self, text: str, chars: list[int], tokens: list[int], block: int = BLOCK):
        self.text, self.block = text, block
        self._build(chars, tokens)
        self.encoded = 0  # pre-tokens encoded by edits so far

    @classmethod
    def of(cls, text: str, count: dict, block: int = BLOCK) -> CountTree:
        parts = bpe.SEGMENT.findall(text)
        count.learn(set(parts))
        return cls(text, *_leaves(parts, count, block), block)

    def _build(self, chars: list[int], tokens: list[int]) -> None:
        self.leaves = max(1, len(chars))
        self.size = 1 << (self.leaves - 1).bit_length()
        self.chars = [0] * self.size + list(chars) + [0] * (self.size - len(chars))
        self.tokens = [0] * self.size + list(tokens) + [0] * (self.size - len(tokens))
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def leaf_values(self) -> tuple[list[int], list[int]]:
        return self.chars[self.size : self.size + self.leaves], self.tokens[self.size : self.size + self.leaves]

    def _find(self, at: int) -> tuple[int, int]:
        """The first leaf that ends at or after character ``at``, and where it starts."""
        i, before = 1, 0
        while i < self.size:
            left = self.chars[2 * i]
            if before + left >= at:
                i = 2 * i
            else:
                before += left
                i = 2 * i + 1
        return min(i - self.size, self.leaves - 1), before

    def _set(self, leaf: int, chars: int, tokens: int) -> None:
        i = leaf + self.size
        dc, dt = chars - self.chars[i], tokens - self.tokens[i]
        while i and (dc or dt):
            self.chars[i] += dc
            self.tokens[i] += dt
            i //= 2

    def edit(self, start: int, length: int, put: str, count: dict) -> None:
        """Replace ``length`` characters from ``start`` by ``put``; both are cut to the text."""
        start = min(max(0, start), len(self.text))
        stop = min(start + max(0, length), len(self.text))
        # A boundary stands if a word starts between it and the edit; white space is cut by what follows it.
        first, begin = self._find(start)
        while first and not bpe.WORD.search(self.text, begin, start):
            first -= 1
            begin -= self.chars[first + self.size]
        last, shift = first, len(put) - (stop - start)
        old_end = begin + self.chars[first + self.size]
        self.text = text = self.text[:start] + put + self.text[stop:]
        parts, at = [], begin
        while True:
            while old_end < stop and last + 1 < self.leaves:
                last += 1
                old_end += self.chars[last + self.size]
            goal = old_end + shift if last + 1 < self.leaves else len(text)
            while at < goal:
                m = bpe.SEGMENT.match(text, at)
                parts.append(m[0])
                at = m.end()
            if at == goal:
                break
            last += 1
            old_end += self.chars[last + self.size]
        count.learn(set(parts))
        self.encoded += len(parts)
        room = last - first + 1
        per_leaf = -(-len(parts) // room)
        if per_leaf > 4 * self.block:  # a leaf would grow large: new leaves in place of the old
            chars, tokens = self.leaf_values()
            c, t = _leaves(parts, count, self.block)
            self._build(chars[:first] + c + chars[last + 1 :], tokens[:first] + t + tokens[last + 1 :])
            return
        for k in range(room):
            own = parts[k * per_leaf : (k + 1) * per_leaf]
            self._set(first + k, sum(map(len, own)), sum(map(count.__getitem__, own)))


def _leaves(parts: list[str], count: dict, block: int) -> tuple[list[int], list[int]]:
    cuts = range(0, len(parts), block)
    return [sum(map(len, parts[i : i + block])) for i in cuts], [sum(map(count.__getitem__, parts[i : i + block])) for i in cuts]


def count_trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, block: int = BLOCK) -> DataFrame:
    """``doc_id, text, n_tokens, n_pretokens`` and the leaf arrays of every row of ``docs``, to be stored.

    A null or empty text has no token and no leaf.  Null ids stay, repeated rows are counted
    each for itself, an empty table gives an empty one.
    """
    path = tokenizer_path or bpe.default_path()

    def rows(given: Columns) -> Columns:
        count = bpe.lookups(path)["count"]
        chars, tokens, n = [], [], []
        for at in range(0, len(given["text"]), TOGETHER):
            cut = [bpe.SEGMENT.findall(text) for text in given["text"][at : at + TOGETHER]]
            count.learn(set().union(*cut))
            for parts in cut:
                c, t = _leaves(parts, count, block)
                chars.append(c)
                tokens.append(t)
                n.append(len(parts))
        return {
            "doc_id": given["doc_id"],
            "text": given["text"],
            "n_tokens": [sum(t) for t in tokens],
            "n_pretokens": n,
            "leaf_chars": chars,
            "leaf_tokens": tokens,
        }

    return map_columns(
        id_text(docs, id_col, text_col),
        per_row(rows),
        "doc_id long, text string, n_tokens long, n_pretokens long, leaf_chars array<int>, leaf_tokens array<int>",
    )


def recount(trees: DataFrame, edits_col: str = "edits", tokenizer_path: str | None = None, block: int = BLOCK) -> DataFrame:
    """Trees after the edits of ``edits_col``, an array of (start, length, put) applied in order.

    ``start`` counts characters of the text as the earlier edits left it; positions are cut to
    the text, null edits and a null array change nothing, a null ``put`` deletes.  Adds
    ``n_before`` and ``n_reencoded``, the pre-tokens that had to be encoded again.
    """
    path = tokenizer_path or bpe.default_path()

    def rows(given: Columns) -> Columns:
        count = bpe.lookups(path)["count"]
        out: Columns = {k: [] for k in ("doc_id", "text", "n_before", "n_tokens", "n_reencoded", "leaf_chars", "leaf_tokens")}
        for doc, text, c, t, edits in zip(*(given[k] for k in ("doc_id", "text", "leaf_chars", "leaf_tokens", "edits")), strict=True):
            tree = CountTree(text, c, t, block)
            before = tree.n_tokens
            for e in edits or ():
                if e is not None:
                    tree.edit(e["start"] or 0, e["length"] or 0, e["put"] or "", count)
            c, t = tree.leaf_values()
            for k, v in zip(out, (doc, tree.text, before, tree.n_tokens, tree.encoded, c, t), strict=True):
                out[k].append(v)
        return out

    return map_columns(
        trees.select("doc_id", "text", "leaf_chars", "leaf_tokens", F.col(edits_col).alias("edits")),
        per_row(rows),
        "doc_id long, text string, n_before long, n_tokens long, n_reencoded long, leaf_chars array<int>, leaf_tokens array<int>",
    )


def drawn_edits(docs: DataFrame, text_col: str = "text", n: int = 3, span: int = 12) -> DataFrame:
    """``docs`` with ``edits``: ``n`` replacements per row at places that follow from its id, each put text taken from the row itself."""
    size = F.length(text_col)

    def at(i: int):
        return F.pmod(F.xxhash64("doc_id", F.lit(i)), size + 1).cast("int")

    return docs.withColumn(
        "edits",
        F.array(
            *[
                F.struct(
                    at(2 * i).alias("start"),
                    F.lit(span * (i % 3)).alias("length"),
                    F.substring(F.col(text_col), at(2 * i + 1) + 1, F.lit(span * ((i + 1) % 3))).alias("put"),
                )
                for i in range(n)
            ]
        ),
    )
