"""Katz backoff language model of words: Good-Turing discounts, exactly normalised backoff weights.

Documents are coded once into chunks: token numbers of a local vocabulary, word hashes and counts.
Chunks ask hashed partitions of the n-gram space for what they need: counts of their words, counts
of their word pairs, backoff weights of their histories.  Each partition adds up what all chunks
know of its n-grams and answers every chunk, so each n-gram is counted in one place and no table of
the whole vocabulary is held anywhere.  The partition of a word also numbers it, common words first;
pairs travel as these numbers.  Histories that are common are spread by their second word.

    P(w)    = d(c) c / N                   for words of the training texts, the rest for all others
    P(w|h)  = d(c) c / c(h)                for pairs of the training texts
            = a(h) P(w)                    for others, a(h) such that all P(.|h) add up to one
            = P(w)                         after an unseen word

The word before the first one of a text is the end token.
"""

from __future__ import annotations

import gc
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.durable import cut_lineage
from gridweave.llm.common import Columns, id_text, map_columns

# Counts up to this one are discounted.
CUT = 5
CHUNK_TOKENS = 1_500_000
# n-grams that a partition should hold at most, and the share of them from which a history is spread.
PART_ROWS = 1_000_000
HOT_SHARE = 0.1

_U = np.uint64
_END = 0  # hash of the end token
# Multipliers of a 64-bit mixer.
_A, _B = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9)

_ROW = "part int, chunk long, kind int, data array<binary>"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _B
    return (x ^ (x >> _U(29))) * _A


def _pack(a: np.ndarray) -> bytes:
    """Compressed byte by byte of the values, as the high bytes are mostly alike."""
    flat = np.ascontiguousarray(a).reshape(-1)
    return zlib.compress(flat.view("u1").reshape(-1, flat.itemsize).T.tobytes(), 1)


def _unpack(b: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(np.frombuffer(zlib.decompress(b), "u1").reshape(size, -1).T.tobytes(), kind)


def _pack_rising(a: np.ndarray) -> bytes:
    return _pack(np.diff(a, prepend=_U(0)).astype("<u8"))


def _unpack_rising(b: bytes) -> np.ndarray:
    return np.cumsum(_unpack(b, "<u8"), dtype=_U)


# -- coding ------------------------------------------------------------------
class _Chunk:
    """Texts coded until they hold enough tokens: local numbers by first use, 0 for the end token."""

    def __init__(self):
        self.place: dict[bytes, int] = {}
        self.tokens: list[np.ndarray] = []
        self.docs: list = []
        self.size = 0

    def add(self, doc, text: str, train: bool) -> None:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        place = self.place
        ids = np.fromiter((place.setdefault(w, len(place) + 1) for w in words), np.uint32, len(words))
        self.tokens.append(np.append(ids, np.uint32(0)))
        self.docs.append((doc, train, len(words) + 1))
        self.size += len(words) + 1

    def row(self, number: int) -> Columns:
        tokens = np.concatenate(self.tokens)
        train = np.repeat([t for _, t, _ in self.docs], [n for _, _, n in self.docs])
        words = np.fromiter((xxhash.xxh64_intdigest(w) or 1 for w in self.place), _U, len(self.place))
        counts = np.bincount(tokens[train], minlength=len(words) + 1).astype("<u4")
        ids = np.array([-1 if d is None else d for d, _, _ in self.docs], "<i8")
        null = np.array([d is None for d, _, _ in self.docs], "u1")
        flags = np.array([t for _, t, _ in self.docs], "u1")
        sizes = np.array([n for _, _, n in self.docs], "<u4")
        data = [_pack(x) for x in (tokens.astype("<u4"), np.concatenate([[_U(_END)], words]), counts, ids, null, flags, sizes)]
        return {"part": [0], "chunk": [number], "kind": [0], "data": [data], "tokens": [int(train.sum())], "grams": [self.size]}


def chunks(docs: DataFrame, held: str, id_col: str, text_col: str, chunk_tokens: int) -> DataFrame:
    given = id_text(docs, id_col, text_col).select("doc_id", "text", F.expr(held).alias("held"))

    def make():
        state = {"chunk": _Chunk(), "n": 0}
        first = TaskContext.get().partitionId() << 24

        def work(given: Columns | None) -> Iterator[Columns]:
            for doc, text, out in zip(given["doc_id"], given["text"], given["held"], strict=True) if given else ():
                state["chunk"].add(doc, text, not out)
                if state["chunk"].size >= chunk_tokens:
                    yield state["chunk"].row(first + state["n"])
                    state.update(chunk=_Chunk(), n=state["n"] + 1)
            if given is None and state["chunk"].docs:
                yield state["chunk"].row(first + state["n"])

        return work

    return map_columns(given, make, _ROW + ", tokens long, grams long")


@dataclass(frozen=True)
class _Coded:
    tokens: np.ndarray
    words: np.ndarray
    counts: np.ndarray
    ids: np.ndarray
    null: np.ndarray
    train: np.ndarray  # by document
    sizes: np.ndarray

    @classmethod
    def of(cls, data: list[bytes]) -> _Coded:
        kinds = ("<u4", "<u8", "<u4", "<i8", "u1", "u1", "<u4")
        return cls(*(_unpack(b, k) for b, k in zip(data, kinds, strict=True)))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs as history << 32 | word, how often each stands in training texts, and the pair of each token."""
        before = np.empty_like(self.tokens)
        before[0], before[1:] = 0, self.tokens[:-1]
        own = (before.astype(_U) << _U(32)) | self.tokens.astype(_U)
        found, at = np.unique(own, return_inverse=True)
        trained = np.repeat(self.train.astype(bool), self.sizes)
        return found, np.bincount(at[trained], minlength=len(found)).astype("<u4"), at


def _dealt(parts: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Positions of each part, in their order."""
    order = np.argsort(parts, kind="stable")
    cuts = np.searchsorted(parts[order], np.arange(n + 1))
    for p in range(n):
        if cuts[p] < cuts[p + 1]:
            yield p, order[cuts[p] : cuts[p + 1]]


def _word_part(words: np.ndarray, n: int) -> np.ndarray:
    return (_mix(words) % _U(n)).astype(np.int64)


def _dealt_pairs(h: np.ndarray, w: np.ndarray, count: np.ndarray, n: int, hot: float) -> Iterator[tuple[int, np.ndarray]]:
    """Positions of the pairs of each part, by rising numbers of history and word; ``count``: of the history."""
    order = np.lexsort((w, h))
    parts = (_mix(_mix(h) + np.where(count > hot, w, _U(0))) % _U(n)).astype(np.int64)
    for p, at in _dealt(parts[order], n):
        yield p, order[at]


def _grouped(rows: DataFrame, key: str, fn, schema: str = _ROW) -> DataFrame:
    """``fn`` on the rows of each key as a list of dicts."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = list(fn(frame.to_dict("records")))
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return rows.groupBy(key).applyInPandas(run, schema)


# -- discounts ---------------------------------------------------------------
def discounts(of: list[int], cut: int = CUT) -> list[float]:
    """Katz discounts of the counts 0..cut (0 for unused) from the numbers of n-grams seen 1, 2, ..., cut + 1 times.

    Where the Good-Turing estimate is not between 0 and 1, as in small corpora, absolute discounting stands in.
    """
    n = [0, *of]
    beyond = (cut + 1) * n[cut + 1] / n[1] if n[1] else 1.0
    flat = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    out = [0.0]
    for r in range(1, cut + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - beyond) / (1 - beyond) if n[r] and beyond < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - flat) / r)
    return out


@dataclass(frozen=True)
class Unigrams:
    """P(w) by the count of w; ``unseen`` is what all unknown words share."""

    total: int
    distinct: int
    d: list[float]
    unseen: float

    @classmethod
    def of(cls, total: int, distinct: int, counts: list[int]) -> Unigrams:
        d = discounts(counts)
        lost = sum((1 - d[r]) * r * counts[r - 1] for r in range(1, CUT + 1)) / max(total, 1)
        if total and lost <= 0:  # all words are common: one more token makes room
            return cls(total, distinct, [1.0 * total / (total + 1)] * (CUT + 2), 1 / (total + 1))
        return cls(total, distinct, [*d, 1.0], lost if total else 1.0)

    def p(self, c: np.ndarray) -> np.ndarray:
        c = c.astype(np.int64)
        return np.where(c > 0, np.array(self.d)[np.minimum(c, CUT + 1)] * c / max(self.total, 1), self.unseen)


def _histogram(c: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(c, CUT + 2), minlength=CUT + 3)[1 : CUT + 2].tolist()


# -- scoring -----------------------------------------------------------------
def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: str = "pmod(crc32(cast(doc_id AS string)), 10) = 0", add: float = 0.1, chunk_tokens: int = CHUNK_TOKENS, part_rows: int = PART_ROWS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, log10_per_token``.

    The model learns from the rows for which the SQL condition ``held`` is not true; a null id is
    never held out and stays null.  Null and empty texts hold the end token alone; repeated rows are
    learned from and scored each; an empty table gives an empty one.  Words are told apart by 64-bit
    hashes, texts are read whole.
    """
    coded = cut_lineage(chunks(docs, f"coalesce({held}, false)", id_col, text_col, chunk_tokens))
    sizes = coded.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"), F.coalesce(F.sum("grams"), F.lit(0)).alias("g")).first()
    parts = max(1, math.ceil(sizes["g"] / part_rows))
    total, hot = sizes["t"], part_rows * HOT_SHARE
    rows = coded.select("part", "chunk", "kind", "data")

    # Words: every chunk sends its counts, every partition answers with the sums.
    def ask_words(given: Columns) -> Iterator[dict]:
        for chunk, data in zip(given["chunk"], given["data"], strict=True):
            words, counts = _unpack(data[1], "<u8"), _unpack(data[2], "<u4")
            for p, at in _dealt(_word_part(words, parts), parts):
                yield {"part": p, "chunk": chunk, "kind": 0, "data": [words[at].tobytes(), counts[at].tobytes()]}

    def add_words(group: list[dict]) -> Iterator[dict]:
        words = np.concatenate([np.frombuffer(r["data"][0], "<u8") for r in group])
        counts = np.concatenate([np.frombuffer(r["data"][1], "<u4") for r in group])
        _, at = np.unique(words, return_inverse=True)
        sums = np.bincount(at, counts).astype("<u8")
        rank = np.empty(len(sums), _U)
        rank[np.argsort(-sums.astype(np.int64), kind="stable")] = np.arange(len(sums), dtype=_U)
        numbers = rank * _U(parts) + _U(group[0]["part"])
        yield from _answers(group, 0, [len(r["data"][0]) // 8 for r in group], sums[at].astype("<u4"), numbers[at].astype("<u8"))
        yield {"part": group[0]["part"], "chunk": None, "kind": 9, "data": [np.array([int((sums > 0).sum()), *_histogram(sums)], "<i8").tobytes()]}

    known = _written(_grouped(_sent(rows, ask_words), "part", add_words))
    distinct, *counts = _sum_stats(known, CUT + 2)
    uni = Unigrams.of(total, distinct, counts)

    # Pairs: counts go out with the counts of both words; answers are the counts of the pairs.
    def ask_pairs(group: list[dict]) -> Iterator[dict]:
        own, c, number = _chunk_with(group, parts)
        if own is None:
            return
        found, trained, _ = own.pairs()
        h, w = (found >> _U(32)).astype(np.int64), (found & _U(0xFFFFFFFF)).astype(np.int64)
        chunk = group[0]["chunk"]
        for p, at in _dealt_pairs(number[h], number[w], c[h], parts, hot):
            starts = np.flatnonzero(np.diff(h[at], prepend=-1))
            runs = np.diff(starts, append=len(at)).astype("<u4")
            words, first, which = np.unique(number[w[at]], return_index=True, return_inverse=True)
            yield {"part": p, "chunk": chunk, "kind": 0, "data": [_pack_rising(number[h[at][starts]]), _pack(runs), _pack_rising(words), _pack(which.astype("<u4")), _pack(trained[at]), _pack(c[w[at][first]].astype("<u4"))]}

    def add_pairs(group: list[dict]) -> Iterator[dict]:
        h = np.concatenate([np.repeat(_unpack_rising(r["data"][0]), _unpack(r["data"][1], "<u4")) for r in group])
        which = [_unpack(r["data"][3], "<u4") for r in group]
        w = np.concatenate([_unpack_rising(r["data"][2])[k] for r, k in zip(group, which, strict=True)])
        trained = np.concatenate([_unpack(r["data"][4], "<u4") for r in group])
        c = np.concatenate([_unpack(r["data"][5], "<u4")[k] for r, k in zip(group, which, strict=True)])
        _, first, at = np.unique(_mix(_mix(h) + w), return_index=True, return_inverse=True)
        sums = np.bincount(at, trained).astype(np.int64)
        yield from _answers(group, 1, [len(k) for k in which], sums[at].astype("<u4"))
        seen = sums > 0
        h, n, p = h[first][seen], sums[seen], uni.p(c[first][seen])
        yield {"part": group[0]["part"], "chunk": None, "kind": 9, "data": [np.array([len(n), *_histogram(n)], "<i8").tobytes()]}
        of, each = np.unique(h, return_inverse=True)
        table = [np.bincount(each, (n == r), len(of)) for r in range(1, CUT + 1)]
        table += [np.bincount(each, np.where(n > CUT, n, 0), len(of)), np.bincount(each, p, len(of))]
        for q, own in _dealt((of % _U(parts)).astype(np.int64), parts):
            yield {"part": q, "chunk": None, "kind": 8, "data": [_pack_rising(of[own]), _pack(np.stack([t[own] for t in table]).astype("<f8"))]}

    with_words = rows.unionByName(known.where("kind = 0"))
    paired = _written(_grouped(_grouped(with_words, "chunk", ask_pairs), "part", add_pairs))
    _, *pair_counts = _sum_stats(paired, CUT + 2)
    d2 = np.array([*discounts(pair_counts), 1.0])

    # Histories: their partial sums meet where the word was numbered, its backoff weight goes to every chunk that has it.
    def weigh(group: list[dict]) -> Iterator[dict]:
        sums = [r for r in group if r["kind"] == 8]
        asked = [r for r in group if r["kind"] == 0]
        h = np.concatenate([_unpack_rising(r["data"][0]) for r in sums] or [np.zeros(0, _U)])
        table = np.concatenate([_unpack(r["data"][1], "<f8").reshape(CUT + 2, -1) for r in sums] or [np.zeros((CUT + 2, 0))], axis=1)
        of, at = np.unique(h, return_inverse=True)
        t = np.stack([np.bincount(at, row, len(of)) for row in table])
        left, scale = backoff(t, d2)
        for r in asked:
            words = _unpack(r["data"][1], "<u8")
            k = np.minimum(np.searchsorted(of, words), max(len(of) - 1, 0))
            hit = of[k] == words if len(of) else np.zeros(len(words), bool)
            both = np.ones((2, len(words)))
            both[:, hit] = np.stack([left, scale])[:, k[hit]]
            yield {"part": r["part"], "chunk": r["chunk"], "kind": 2, "data": [_pack(both.astype("<f8"))]}

    asked = known.where("kind = 0").unionByName(paired.where("kind = 8"))
    weights = _written(_grouped(asked, "part", weigh))

    def finish(group: list[dict]) -> Iterator[dict]:
        own, c, number = _chunk_with(group, parts)
        if own is None:
            return
        found, _, at = own.pairs()
        h, w = (found >> _U(32)).astype(np.int64), (found & _U(0xFFFFFFFF)).astype(np.int64)
        pair = np.zeros(len(found), np.int64)
        deal = dict(_dealt_pairs(number[h], number[w], c[h], parts, hot))
        left, scale = np.ones(len(c)), np.ones(len(c))
        deal_words = dict(_dealt(_word_part(own.words, parts), parts))
        for r in group:
            if r["kind"] == 1:
                pair[deal[r["part"]]] = _unpack(r["data"][0], "<u4")
            elif r["kind"] == 2:
                left[deal_words[r["part"]]], scale[deal_words[r["part"]]] = _unpack(r["data"][0], "<f8").reshape(2, -1)
        direct = d2[np.minimum(pair, CUT + 1)] * pair / np.maximum(c[h], 1) * scale[h]
        log_p = np.log10(np.where(pair > 0, direct, left[h] * uni.p(c[w])))[at]
        base = np.log10((c + add) / (total + add * (distinct + 1)))[own.tokens]
        starts = np.concatenate([[0], np.cumsum(own.sizes.astype(np.int64))[:-1]])
        sums = (np.add.reduceat(x, starts) for x in (log_p, base, (c[own.tokens] > 0).astype(np.int64)))
        for doc, null, train, n, s, b, k in zip(own.ids.tolist(), own.null, own.train, own.sizes.tolist(), *sums, strict=True):
            yield {"doc_id": None if null else doc, "held_out": not train, "n_tokens": n, "n_known": int(k), "train_tokens": total, "base_score": float(b), "score": float(s), "log10_per_token": float(s) / n}

    everything = rows.unionByName(known.where("kind = 0")).unionByName(paired.where("kind = 1")).unionByName(weights)
    result = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, log10_per_token double"

    def in_nulls(frame: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(list(finish(frame.to_dict("records"))), columns=[c.split()[0] for c in result.split(", ")])
        return out.astype({"doc_id": "Int64"})

    return everything.groupBy("chunk").applyInPandas(in_nulls, result)


def backoff(t: np.ndarray, d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Backoff weights of histories, and the factor on their seen pairs, from their sums.

    ``t``: rows of the numbers of pairs seen 1..CUT times, the count of all others, and P(w) summed over seen w.
    """
    r = np.arange(1, CUT + 1)[:, None]
    count = (t[:CUT] * r).sum(0) + t[CUT]
    kept = ((t[:CUT] * r * d2[1 : CUT + 1, None]).sum(0) + t[CUT]) / np.maximum(count, 1)
    none = kept >= 1 - 1e-12  # nothing was discounted: one more token makes room
    scale = np.where(none, count / (count + 1), 1.0)
    return (1 - kept * scale) / np.maximum(1 - t[CUT + 1], 1e-12), scale


def _written(df: DataFrame) -> DataFrame:
    """``df`` as a table; the shuffle files of its making are no longer referred to and may go."""
    out = cut_lineage(df)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def _sent(rows: DataFrame, ask) -> DataFrame:
    def make():
        def work(given: Columns | None) -> Iterator[Columns]:
            for row in ask(given) if given else ():
                yield {k: [v] for k, v in row.items()}

        return work

    return map_columns(rows.select("chunk", "data"), make, _ROW)


def _answers(group: list[dict], kind: int, sizes: list[int], *values: np.ndarray) -> Iterator[dict]:
    """``values`` of all requests of a group, cut into one answer per request."""
    at = 0
    for r, n in zip(group, sizes, strict=True):
        yield {"part": r["part"], "chunk": r["chunk"], "kind": kind, "data": [_pack(v[at : at + n]) for v in values]}
        at += n


def _chunk_with(group: list[dict], parts: int) -> tuple[_Coded | None, np.ndarray | None, np.ndarray | None]:
    """The chunk of a group, and the training counts and numbers of its words, put together from the answers."""
    coded = [r for r in group if len(r["data"]) == 7]
    if not coded:
        return None, None, None
    own = _Coded.of(coded[0]["data"])
    c, number = np.zeros(len(own.words), np.int64), np.zeros(len(own.words), _U)
    deal = dict(_dealt(_word_part(own.words, parts), parts))
    for r in group:
        if r["kind"] == 0 and len(r["data"]) == 2:
            c[deal[r["part"]]], number[deal[r["part"]]] = _unpack(r["data"][0], "<u4"), _unpack(r["data"][1], "<u8")
    return own, c, number


def _sum_stats(answers: DataFrame, n: int) -> list[int]:
    """Sums of the few numbers that each partition says of itself."""
    out = np.zeros(n, np.int64)
    for r in answers.where("kind = 9").select("data").collect():
        out += np.frombuffer(r["data"][0], "<i8")
    return out.tolist()
