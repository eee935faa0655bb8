"""Near duplicates by SuperMinHash signatures, banding, verification on full sets and union of the links.

Equal sets are one node from the start.  In each band a node is compared with the
most shared node of its bucket, so a group of copies gives as many pairs as it has members; then so
are the components of a bucket.  Nodes of buckets that still hold several components meet along
their rarest shingles, which every pair of the similarity must share, so texts that resemble each
other without a link are not paired.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.durable import cut_lineage
from gridweave.llm.common import Columns, id_text, map_columns, per_row, worker_store

WORDS = 5
SIMILARITY = 0.75
# 32 bands of 4 ranks miss a pair of similarity 0.75 with probability 6e-6.
BANDS, ROWS = 32, 4
SIZE = BANDS * ROWS
# Pairs whose signatures agree in a smaller share are not verified: five standard errors below 0.75.
LEAST_AGREEMENT = 0.55

_U = np.uint64
# The constants of the splitmix64 finalizer.
_GOLD, _M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_MOST_WORDS = 400_000


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MOST_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


def shingles(text: str, words: dict) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a text of fewer words is one shingle, one without words none."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(w)
    if not n:
        return np.zeros(0, _U)
    h = np.fromiter(map(words.__getitem__, w), _U, n)
    if n < WORDS:
        h = np.concatenate([h, np.full(WORDS - n, n, _U)])
        n = WORDS
    out = h[: n - WORDS + 1].copy()
    for k in range(1, WORDS):
        out = _mix(out * _GOLD + h[k : n - WORDS + 1 + k])
    return np.unique(out)


def signatures(sets: list[np.ndarray], size: int = SIZE) -> np.ndarray:
    """SuperMinHash of non-empty sets, one row of ``size`` values each.

    Level j gives each element a fresh value in [j, j + 1) at the j-th place of its own random
    permutation.  A set stops as soon as all its places hold values below the next level.
    """
    lengths = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), lengths)
    h = np.concatenate(sets)
    sig = np.full(len(sets) * size, np.inf)

    def draw(of: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        u = _mix(of + _U((int(_GOLD) * (level + 1)) % (1 << 64)))
        where = (_mix(u + _GOLD) % _U(size - level)).astype(np.int64) + level
        return (u >> _U(11)).astype(np.float64) * 2.0**-53 + level, where

    r, k = draw(h, 0)
    np.minimum.at(sig, owner * size + k, r)
    open_ = sig.reshape(-1, size).max(1) >= 1
    if open_.any():
        on = open_[owner]
        h, owner, k = h[on], owner[on], k[on]
        places = np.tile(np.arange(size, dtype=np.uint8 if size <= 256 else np.uint16), (len(h), 1))
        each = np.arange(len(h))
        places[each, 0], places[each, k] = k, 0
        for level in range(1, size):
            r, k = draw(h, level)
            at = places[each, k].astype(np.int64)
            np.minimum.at(sig, owner * size + at, r)
            places[each, k] = places[each, level]
            places[each, level] = at
            still = sig.reshape(-1, size).max(1) >= level + 1
            if not still.any():
                break
            on = still[owner]
            if on.mean() < 0.7:
                h, owner, places = h[on], owner[on], places[on]
                each = np.arange(len(h))
    return sig.reshape(-1, size)


def _bands(sig: np.ndarray) -> np.ndarray:
    bits = sig.view(_U).reshape(len(sig), BANDS, ROWS)
    out = np.arange(BANDS, dtype=_U)[None, :] * _GOLD
    for k in range(ROWS):
        out = _mix(out + bits[:, :, k] * _M1 + _GOLD)
    return out.view(np.int64)


def _codes(sig: np.ndarray) -> np.ndarray:
    """Eight bits of each value, eight values to a long."""
    return _mix(sig.view(_U)).astype(np.uint8).view(np.int64).reshape(len(sig), SIZE // 8)


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_key, n_shingles, f1, f2, bands, codes`` of every row; equal sets have equal ``f1, f2``."""

    def rows(given: Columns) -> Columns:
        words = worker_store("word hashes").setdefault("all", _WordHash())
        sets = [shingles(t, words) for t in given["text"]]
        full = [i for i, s in enumerate(sets) if len(s)]
        bands: list = [None] * len(sets)
        codes: list = [None] * len(sets)
        at = 0
        while at < len(full):
            upto, size = at, 0
            while upto < len(full) and (upto == at or size + len(sets[full[upto]]) <= 100_000):
                size += len(sets[full[upto]])
                upto += 1
            sig = signatures([sets[i] for i in full[at:upto]])
            for i, b, c in zip(full[at:upto], _bands(sig), _codes(sig), strict=True):
                bands[i], codes[i] = b, c
            at = upto
        sums = [(int(_mix(s).sum(dtype=_U).view(np.int64)), int(_mix(s ^ _M2).sum(dtype=_U).view(np.int64))) for s in sets]
        return {"doc_id": given["doc_id"], "text_key": given["text_key"], "n_shingles": [len(s) for s in sets], "f1": [a for a, _ in sums], "f2": [b for _, b in sums], "bands": bands, "codes": codes}

    keyed = id_text(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    return map_columns(keyed, per_row(rows), "doc_id long, text_key long, n_shingles long, f1 long, f2 long, bands array<long>, codes array<long>")


def _agreement(a: str, b: str) -> Column:
    """Share of equal bytes of two arrays of longs: the bits of a differing byte are folded into its lowest one."""

    def differing(i: int) -> Column:
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        for by in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, by))
        return F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))

    return 1 - functools.reduce(operator.add, [differing(i) for i in range(SIZE // 8)]) / SIZE


def _alike(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """``pairs`` (a, b) with ``agree``, without those whose sizes or signatures rule the similarity out."""
    a = nodes.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("codes").alias("ca"))
    b = nodes.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("codes").alias("cb"))
    near = F.least("na", "nb") >= F.greatest("na", "nb") * (similarity - 1e-9)
    both = pairs.join(a, "a").join(b, "b").where(near).select("a", "b", _agreement("ca", "cb").alias("agree"))
    return both.where(F.col("agree") >= LEAST_AGREEMENT + similarity - SIMILARITY)


def verified(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough.  ``texts``: node, text, one row per node."""
    percent = round(similarity * 100)
    a = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))

    def rows(given: Columns) -> Columns:
        words = worker_store("word hashes").setdefault("all", _WordHash())
        out: Columns = {"a": [], "b": []}
        last, kept = None, None
        for x, y, tx, ty in zip(given["a"], given["b"], given["ta"], given["tb"], strict=True):
            if x != last:
                last, kept = x, shingles(tx, words)
            other = shingles(ty, words)
            common = len(np.intersect1d(kept, other, assume_unique=True))
            if 100 * common >= percent * (len(kept) + len(other) - common):
                out["a"].append(x)
                out["b"].append(y)
        return out

    # The pairs follow their first member, whose set is then built once for many of them.
    return map_columns(pairs.select("a", "b").join(b, "b").join(a, "a").select("a", "b", "ta", "tb"), per_row(rows), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) of every node with a link, by alternating large and small stars.

    Only per-node minima and joins are used, so no group is gathered in one place.
    """
    edges = cut_lineage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    was = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if was == tuple(now):
            break
        was = tuple(now)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = cut_lineage(
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
            .select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _star(rows: DataFrame) -> DataFrame:
    """Pairs of each bucket's most shared node (a) with that of every other component in the bucket (b)."""
    top = F.max(F.struct("fame", "node"))
    shown = rows.groupBy("band", "component").agg(top.alias("top")).select("band", "component", "top.fame", "top.node")
    center = shown.groupBy("band").agg(F.max(F.struct("fame", "node")).alias("center")).select("band", F.col("center.node").alias("a"))
    return shown.join(center, "band").where("a <> node").select("a", F.col("node").alias("b")).distinct()


def _rare_pairs(open_: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes of different components among which are all that are similar enough.

    ``open_``: node, component, in any number of rows; ``texts``: node, text.  With the shingles of each
    node in one common order, rare ones first, the first one that two nodes share bounds what they share.
    """
    percent = round(similarity * 100)

    def rows(given: Columns) -> Columns:
        words = worker_store("word hashes").setdefault("all", _WordHash())
        return {"node": given["node"], "shingles": [shingles(t, words).view(np.int64) for t in given["text"]]}

    sets = cut_lineage(map_columns(texts, per_row(rows), "node long, shingles array<long>"))
    each = sets.select("node", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("shingle"))
    shared = each.join(each.groupBy("shingle").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1"), "shingle")
    own = Window.partitionBy("node")
    # ``rest``: the shingles from this one on; those that no other node has come first.
    rest = F.count(F.lit(1)).over(own) - F.row_number().over(own.orderBy("holders", "shingle")) + 1
    prefix = shared.withColumn("rest", rest).where(F.col("rest") * 100 >= F.col("n") * percent)
    keyed = cut_lineage(prefix.join(open_.select("node", "component").distinct(), "node").select("shingle", "node", "component", "n", "rest"))
    by_part = keyed.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("n"))
    sides = (
        by_part.groupBy("shingle")
        .agg(F.max(F.struct("k", "component")).alias("main"), F.min(F.struct("n", "component")).alias("low"), F.count(F.lit(1)).alias("parts"))
        .where("parts > 1")
        .select("shingle", F.col("main.component").alias("main"), F.col("low.n").alias("low"), F.col("low.component").alias("low_part"))
    )
    others = by_part.join(sides, "shingle").where("component <> low_part").groupBy("shingle", "main", "low", "low_part").agg(F.min("n").alias("next"))
    # Rows that even the smallest set of another component could not be similar to go first.
    smallest = F.when(F.col("component") == F.col("low_part"), F.col("next")).otherwise(F.col("low"))
    able = F.col("rest") * (100 + percent) >= (F.col("n") + smallest) * percent
    left = cut_lineage(keyed.join(others, "shingle").where(able).select("shingle", "main", "node", "component", "n", "rest"))
    x = left.where("component <> main").select("shingle", "main", F.col("node").alias("x"), F.col("component").alias("kx"), F.col("n").alias("nx"), F.col("rest").alias("rx"))
    y = left.select("shingle", F.col("node").alias("y"), F.col("component").alias("ky"), F.col("n").alias("ny"), F.col("rest").alias("ry"))
    fits = F.least("rx", "ry") * (100 + percent) >= (F.col("nx") + F.col("ny")) * percent
    met = x.join(y, "shingle").where(F.expr("kx <> ky AND (ky = main OR x < y)") & fits)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    ``component_id`` is the smallest id reachable over links, itself included.  Null and empty texts
    and texts without words are linked with nothing.  A row with a null id is linked with nothing and
    has a null component.  Repeated rows share their component; ``kept`` is true for each of them.  An
    empty table gives an empty one.
    """
    rows = cut_lineage(sketch(docs, id_col, text_col))
    # A node is a distinct set, shown by one row that has it.
    usable = rows.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)).withColumn("node", F.xxhash64("n_shingles", "f1", "f2"))
    classes = usable.groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("shown"))
    classes = cut_lineage(classes.select("node", F.col("shown.doc_id").alias("id"), F.col("shown.text_key").alias("text_key")))
    nodes = cut_lineage(
        usable.withColumnRenamed("doc_id", "id")
        .select("node", "id", "text_key", "n_shingles", "bands", "codes")
        .join(classes, ["node", "id", "text_key"], "left_semi")
        .groupBy("node", "id", "text_key")
        .agg(F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("codes").alias("codes"))
    )
    banded = nodes.select("node", F.explode("bands").alias("band"))
    sizes = banded.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    banded = cut_lineage(banded.join(sizes, "band"))
    # What others were copied from shares more bands with them than they do with each other.
    fame = cut_lineage(banded.groupBy("node").agg(F.sum("size").alias("fame")))
    banded = cut_lineage(banded.join(fame, "node").select("band", "node", "fame"))
    texts = id_text(docs, id_col, text_col).select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_key"), "text")

    def text_of(wanted: DataFrame) -> DataFrame:
        """Texts of the nodes in ``wanted``: only those move, and repeated rows count once."""
        needed = wanted.select("node").distinct().join(nodes.select("node", "id", "text_key"), "node")
        return texts.join(needed, ["id", "text_key"]).groupBy("id", "text_key", "node").agg(F.first("text").alias("text")).select("node", "text")

    def of(pairs: DataFrame) -> DataFrame:
        return text_of(pairs.select(F.explode(F.array("a", "b")).alias("node")))

    def labelled(comp: DataFrame) -> DataFrame:
        """Rows of buckets that still hold several components."""
        rows = banded.join(comp, "node", "left").select("band", "node", "fame", F.coalesce("component", "node").alias("component"))
        mixed = rows.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("band")
        return cut_lineage(rows.join(mixed, "band", "left_semi"))

    stars = _alike(_star(banded.withColumn("component", F.col("node"))), nodes, similarity)
    first = cut_lineage(stars.groupBy("b").agg(F.max(F.struct("agree", "a")).alias("best")).select("best.a", "b"))
    links = cut_lineage(verified(first, of(first), similarity))
    again = cut_lineage(_alike(_star(labelled(components(links))), nodes, similarity))
    links = cut_lineage(links.unionByName(verified(again, of(again), similarity)))
    open_ = labelled(components(links))
    second = cut_lineage(_rare_pairs(open_, text_of(open_), similarity))
    more = cut_lineage(verified(second, of(second), similarity))
    # Different sets under one id are rows of one document.
    sets = usable.select("doc_id", "node").distinct()
    least = sets.groupBy("doc_id").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "a")
    several = sets.join(least, "doc_id").select("a", F.col("node").alias("b"))
    comp = components(links.unionByName(more).unionByName(several))
    lowest = nodes.select("node", "id").join(comp, "node", "left").select("node", "id", F.coalesce("component", "node").alias("component"))
    named = lowest.groupBy("component").agg(F.min("id").alias("component_id"))
    by_set = cut_lineage(lowest.join(named, "component").select(F.col("node").alias("set"), "component_id"))
    out = rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.xxhash64("n_shingles", "f1", "f2")).alias("set"))
    component = F.coalesce("component_id", "doc_id")
    return out.join(by_set, "set", "left").select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
