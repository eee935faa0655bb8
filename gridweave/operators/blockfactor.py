"""Low-rank factors of many blocks at once.

A block's sample is a set of rows ``(block keys, row, ys ARRAY)``.  Only sums of small
products leave the rows: a ``w x w`` Gram matrix per block is decomposed, and the small
transform goes back to the rows in a spread join.  No block is ever gathered, so a coarse
block with a third of all rows works like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.durable import cut_lineage
from gridweave.functions.gaussian import normals
from gridweave.operators.products import sum_arrays
from gridweave.operators.treeqr import r_factors
from gridweave.skew import hot_table, skew_join

BLOCK = ("depth", "a", "b")
# Directions below this share of the largest singular value are dropped: from a Gram matrix, and from an R factor.
RANK_CUT = 1e-7
R_RANK_CUT = 1e-13
# Numbers of block sums that a task holds before it sends them on, and of products that it makes at once.
HELD_SUMS = 4_000_000
MADE_AT_ONCE = 2_000_000


def _outer_sums(width: int, name: str) -> Column:
    """Upper triangle of the Gram matrix, row by row."""
    cells = [(p, q) for p in range(width) for q in range(p, width)]
    return sum_arrays(len(cells), lambda at: f"{name}[{cells[at][0]}] * {name}[{cells[at][1]}]")


def _square(flat: np.ndarray, width: int) -> np.ndarray:
    gram = np.zeros((len(flat), width, width))
    up = np.triu_indices(width)
    gram[:, up[0], up[1]] = flat
    gram[:, up[1], up[0]] = flat
    return gram


def numbers(lists: pa.ListArray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` numbers of each array of a batch, and which arrays hold no null there; those that do are zeros."""
    ok = lists.is_valid().to_numpy(zero_copy_only=False)
    ends = lists.offsets.to_numpy()
    if (np.diff(ends)[ok] < n).any():
        raise ValueError(f"arrays must hold at least {n} numbers")
    flat = lists.values.to_numpy(zero_copy_only=False).astype(float, copy=False)
    at = ends[:-1][ok, None] + np.arange(n)
    out = np.zeros((len(lists), n))
    out[ok] = flat[at]
    if lists.values.null_count:
        ok = ok.copy()
        ok[ok] = ~lists.values.is_null().to_numpy(zero_copy_only=False)[at].any(axis=1)
        out[~ok] = 0.0
    return out, ok


def lists_of(rows: np.ndarray, ok: np.ndarray, kind: pa.DataType = pa.list_(pa.float64())) -> pa.Array:
    """One array per row, of nulls where not ``ok``."""
    n, width = rows.shape
    flat = pa.array(rows.ravel(), mask=None if ok.all() else np.repeat(~ok, width))
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), flat).cast(kind)


def _doubles(cells: pa.BinaryArray, *shape: int) -> np.ndarray:
    """Doubles of each cell of equal size, ``shape`` per row."""
    lo, hi = (np.frombuffer(cells.buffers()[1], np.int32)[at] for at in (cells.offset, cells.offset + len(cells)))
    return np.frombuffer(cells.buffers()[2], np.uint8)[lo:hi].view(float).reshape(-1, *shape)


def products_of(rows: DataFrame, left: str, n_left: int, right: str, n_right: int, out: str, rule: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """``rows`` with ``out``, an array made of two others by ``rule``, in place of both; nulls where one holds a null.

    The rule sees whole batches.  As an SQL expression, dozens of products in one row make a method that the JVM does not compile.
    """
    keep = [c for c in rows.columns if c not in (left, right, out)]
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, x_ok), (y, y_ok) = numbers(batch.column(left), n_left), numbers(batch.column(right), n_right)
            made = lists_of(rule(x, y).reshape(len(x), -1), x_ok & y_ok) if len(x) else pa.array([], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], made], [*keep, out])

    return rows.mapInArrow(run, ", ".join([*[f"`{c}` {fields[c]}" for c in keep], f"`{out}` array<double>"]))


def _times(rows: DataFrame, name: str, t: str, n: int, cols: int, out: str) -> DataFrame:
    """``rows`` with ``out``, the row vector ``name`` times the flat ``n x cols`` matrix ``t``, in place of ``t``."""
    kept = rows.withColumn("_x", F.col(name))
    return products_of(kept, "_x", n, t, n * cols, out, lambda x, y: np.einsum("nr,nrc->nc", x, y.reshape(-1, n, cols)))


def _transforms(gram: DataFrame, block: Sequence[str], width: int, use: int, k: int, cut: float = RANK_CUT) -> DataFrame:
    """Per block, the ``width x k`` map onto orthonormal columns, as the bytes of its doubles, and its rank.

    It goes to every row of the block, and bytes are copied at once where an array goes number by number.
    The span comes from the first ``use`` sample columns; at most ``k`` directions stay.
    """
    fields = {f.name: f.dataType.simpleString() for f in gram.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            g = _square(np.stack(pdf["gram"].to_numpy()), width)[:, :use, :use]
            val, vec = np.linalg.eigh(g)
            val, vec = val[:, ::-1][:, :k], vec[:, :, ::-1][:, :, :k]
            keep = val > np.maximum(val[:, :1], 0.0) * cut**2
            keep &= val > 0
            keep &= np.arange(val.shape[1])[None, :] < pdf["n_rows"].to_numpy()[:, None]
            scaled = np.where(keep[:, None, :], vec / np.sqrt(np.where(keep, val, 1.0))[:, None, :], 0.0)
            t = np.zeros((len(pdf), width, k))
            t[:, :use, : scaled.shape[2]] = scaled
            sigma = np.zeros((len(pdf), k))
            sigma[:, : val.shape[1]] = np.sqrt(np.where(keep, val, 0.0))
            yield pdf[[*block, "n_rows"]].assign(
                k_eff=keep.sum(axis=1).astype(np.int32), sigma=list(sigma), t=[x.tobytes() for x in t]
            )

    keys = ", ".join(f"{b} {fields[b]}" for b in block)
    return gram.mapInPandas(run, f"{keys}, n_rows long, k_eff int, sigma array<double>, t binary")


def _r_transforms(r: DataFrame, block: Sequence[str], width: int, use: int, k: int, cut: float) -> DataFrame:
    """As ``_transforms``, from R factors of the first ``use`` columns: the map is ``V S^-1`` of their SVD."""
    fields = {f.name: f.dataType.simpleString() for f in r.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            _, sigma, vt = np.linalg.svd(np.stack(pdf["r"].to_numpy()).reshape(-1, use, use))
            sigma, vt = sigma[:, :k], vt[:, :k, :]
            keep = (sigma > sigma[:, :1] * cut) & (sigma > 0)
            keep &= np.arange(sigma.shape[1])[None, :] < pdf["n_rows"].to_numpy()[:, None]
            scaled = np.where(keep[:, None, :], vt.transpose(0, 2, 1) / np.where(keep, sigma, 1.0)[:, None, :], 0.0)
            t = np.zeros((len(pdf), width, k))
            t[:, :use, : scaled.shape[2]] = scaled
            yield pdf[[*block, "n_rows"]].assign(k_eff=keep.sum(axis=1).astype(np.int32), t=[x.tobytes() for x in t])

    keys = ", ".join(f"{b} {fields[b]}" for b in block)
    return r.mapInPandas(run, f"{keys}, n_rows long, k_eff int, t binary")


def _cells(lists: pa.ListArray, n: int) -> tuple[np.ndarray, np.ndarray | None]:
    """As ``numbers``, but nulls inside an array leave its other numbers alone: which cells hold one, or None where all do."""
    values, ok = numbers(lists, n)
    if ok.all():
        return values, None
    there = np.repeat(ok[:, None], n, axis=1)
    some = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False) & ~ok)
    for at in some:
        own = lists[at].as_py()[:n]
        values[at] = [0.0 if x is None else x for x in own]
        there[at] = [x is not None for x in own]
    return values, there


def block_sums(rows: DataFrame, block: Sequence[str], need: Sequence[str], sizes: dict[str, int], rule: Callable[[dict], list]) -> DataFrame:
    """``(block, n_rows, …)``: sums over the rows of each block of the arrays that ``rule`` makes of a batch's columns ``need``.

    ``rule`` gives, for each name of ``sizes``, the numbers (rows x size) and which of them count, or None where all do.
    A task adds up what it reads and sends one row per block on.  As SQL sums, dozens of products in one row make a
    method that the JVM does not compile.
    """
    block = list(block)
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    total = sum(sizes.values())
    most = max(1, HELD_SUMS // max(total, 1))

    def sent(held: dict, sums: np.ndarray, seen: np.ndarray, n: np.ndarray, kinds: dict) -> Iterator[pa.RecordBatch]:
        keys, m = list(held), len(held)
        out = [pa.array([k[at] for k in keys], kinds[b]) for at, b in enumerate(block)] + [pa.array(n[:m])]
        at = 0
        for size in sizes.values():
            flat = pa.array(sums[:m, at : at + size].ravel(), mask=~seen[:m, at : at + size].ravel())
            out.append(pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * size), flat))
            at += size
        made = pa.RecordBatch.from_arrays(out, [*block, "n_rows", *sizes])
        for lo in range(0, m, 10_000):
            yield made.slice(lo, 10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kinds = {}, {}
        sums, seen, n = np.zeros((0, total)), np.zeros((0, total), bool), np.zeros(0, np.int64)
        step = max(1, MADE_AT_ONCE // max(total, 1))
        for batch in (whole.slice(at, step) for whole in batches for at in range(0, whole.num_rows, step)):
            kinds = {b: batch.column(b).type for b in block}
            codes = [batch.column(b).dictionary_encode(null_encoding="encode").indices.to_numpy() for b in block]
            order = np.lexsort(codes) if codes else np.arange(batch.num_rows)
            turns = np.any([c[order][1:] != c[order][:-1] for c in codes], axis=0) if codes else np.zeros(batch.num_rows - 1, bool)
            starts = np.concatenate([[0], np.flatnonzero(turns) + 1])
            firsts = batch.select(block).take(pa.array(order[starts]))
            keys = list(zip(*[firsts.column(b).to_pylist() for b in block], strict=True)) if block else [()]
            if len(held) + len(keys) > most and held:
                yield from sent(held, sums, seen, n, kinds)
                held = {}
                sums[:], seen[:], n[:] = 0.0, False, 0
            at = np.array([held.setdefault(key, len(held)) for key in keys])
            if len(held) > len(n):
                more = max(len(held), 2 * len(n)) - len(n)
                sums, seen = np.vstack([sums, np.zeros((more, total))]), np.vstack([seen, np.zeros((more, total), bool)])
                n = np.concatenate([n, np.zeros(more, np.int64)])
            lo = 0
            for size, (made, there) in zip(sizes.values(), rule({c: batch.column(c) for c in need}), strict=True):
                cut = slice(lo, lo + size)
                sums[at, cut] += np.add.reduceat((made if there is None else np.where(there, made, 0.0))[order], starts, axis=0)
                seen[at, cut] |= True if there is None else np.logical_or.reduceat(there[order], starts, axis=0)
                lo += size
            n[at] += np.diff(np.append(starts, batch.num_rows))
        if held:
            yield from sent(held, sums, seen, n, kinds)

    kind = ", ".join([*[f"`{b}` {fields[b]}" for b in block], "n_rows long", *[f"`{name}` array<double>" for name in sizes]])
    parts = rows.select(*dict.fromkeys([*block, *need])).mapInArrow(run, kind)
    return parts.groupBy(*block).agg(
        F.sum("n_rows").alias("n_rows"), *[sum_arrays(size, lambda c, name=name: f"`{name}`[{c}]").alias(name) for name, size in sizes.items()]
    )


def _upper(x: np.ndarray, there: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Per row, the products that add up to the upper triangle of a Gram matrix."""
    p, q = np.triu_indices(x.shape[1])
    return x[:, p] * x[:, q], None if there is None else there[:, p] & there[:, q]


def gram_table(rows: DataFrame, block: Sequence[str], width: int, name: str) -> DataFrame:
    return block_sums(rows, block, [name], {"gram": width * (width + 1) // 2}, lambda col: [_upper(*_cells(col[name], width))])


def block_orth(
    samples: DataFrame,
    row: str,
    width: int,
    k: int,
    method: str = "svd",
    block: Sequence[str] = BLOCK,
    out: str = "us",
    rank_cut: float | None = None,
) -> DataFrame:
    """Orthonormal basis rows of each block's sample: input columns plus ``out`` and ``k_eff``.

    ``method='qr'`` spans the first ``k`` sample columns; ``'svd'`` takes the ``k`` leading
    left singular directions of the whole sample.  Where a block has fewer rows or a lower
    rank than ``k``, ``k_eff`` says so and the remaining columns are zero.  ``samples`` is
    read twice and should be a written table.  ``'qr'`` takes the first transform from a tree of
    R factors, which does not square the condition number, ``'svd'`` from a Gram matrix, which
    does; a second pass over the near-orthonormal columns brings them to rounding.  Directions
    below ``rank_cut`` of the largest (``R_RANK_CUT``, ``RANK_CUT``) are dropped.
    """
    if method not in ("qr", "svd"):
        raise ValueError(f"method must be 'qr' or 'svd', got {method!r}")
    if not 0 < k <= width:
        raise ValueError(f"k must be in [1, {width}], got {k}")
    block = list(block)
    use = k if method == "qr" else width
    kept = [c for c in samples.columns if c not in block]
    # The small transforms are written, so that the joins see their size and may broadcast them.
    if method == "qr":
        found = _r_transforms(r_factors(samples, block, "ys", width, use), block, width, use, k, R_RANK_CUT if rank_cut is None else rank_cut)
    else:
        found = _transforms(gram_table(samples, block, width, "ys"), block, width, use, k, RANK_CUT if rank_cut is None else rank_cut)
    first = cut_lineage(found.select(*block, "t"))
    hot = hot_table(samples, block)

    # The rough columns are made anew in both passes, which takes less than writing and reading them.
    def rough(ys: pa.ListArray, t: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        x, ok = numbers(ys, width)
        return np.einsum("nr,nrc->nc", x, _doubles(t, width, k)), ok

    def rough_gram(col: dict) -> list:
        x, ok = rough(col["ys"], col["t"])
        return [_upper(x, None if ok.all() else np.repeat(ok[:, None], k, axis=1))]

    met = skew_join(samples, first, block, [row], hot)
    gram = block_sums(met, block, ["ys", "t"], {"gram": k * (k + 1) // 2}, rough_gram)
    second = _transforms(gram, block, k, k, k).select(*block, "k_eff", F.col("t").alias("_t2"))
    both = cut_lineage(first.join(second, block))
    fields = {f.name: f.dataType.simpleString() for f in both.schema.fields} | {f.name: f.dataType.simpleString() for f in samples.schema.fields}
    names = [*block, *[c for c in kept if c != out], "k_eff"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, ok = rough(batch.column("ys"), batch.column("t"))
                made = lists_of(np.einsum("nr,nrc->nc", x, _doubles(batch.column("_t2"), k, k)), ok)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], made], [*names, out])

    kind = ", ".join([*[f"`{c}` {fields[c]}" for c in names], f"`{out}` array<double>"])
    return skew_join(samples, both, block, [row], hot).mapInArrow(run, kind)


def orth_report(basis: DataFrame, k: int, block: Sequence[str] = BLOCK, out: str = "us", tol: float = 1e-10) -> DataFrame:
    """Per block: rows, rank, and whether the basis is orthonormal to ``tol``."""
    gram = basis.groupBy(*block).agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("k_eff").alias("k_eff"), _outer_sums(k, out).alias("gram")
    )
    cells = [(p, q) for p in range(k) for q in range(p, k)]
    tests = [
        f"abs(gram[{at}] - {f'if(k_eff > {p}, 1.0D, 0.0D)' if p == q else '0.0D'}) <= {tol!r}D"
        for at, (p, q) in enumerate(cells)
    ]
    return gram.select(*block, "n_rows", "k_eff", F.expr(" AND ".join(tests)).alias("orth_ok"))


def two_sample_compress(
    y: DataFrame, z: DataFrame, width: int, k: int, method: str = "svd", block: Sequence[str] = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """Column and row bases of each block from its two samples ``(i, ys)`` and ``(j, ys)``."""
    return (
        block_orth(y, "i", width, k, method, block, "us"),
        block_orth(z, "j", width, k, method, block, "vs"),
    )


def core_matrix(
    u: DataFrame, v: DataFrame, width: int, k: int, seed_u: int, seed_v: int, block: Sequence[str] = BLOCK
) -> DataFrame:
    """Core of each block, ``(G_a^T U)^+ (G_a^T Y) (V^T G_b)^+``, flat in ``core``.

    ``u`` rows carry the sample ``ys``; the Gaussians are recomputed from their keys.  Three
    small products are sums over rows; only they are solved, one row per block.
    """
    block = list(block)

    def outer(x: np.ndarray, x_there: np.ndarray | None, y: np.ndarray, y_there: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
        n, cells = len(x), x.shape[1] * y.shape[1]
        made = (x[:, :, None] * y[:, None, :]).reshape(n, cells)
        if x_there is None and y_there is None:
            return made, None
        x_there, y_there = (np.ones(z.shape, bool) if t is None else t for z, t in ((x, x_there), (y, y_there)))
        return made, (x_there[:, :, None] & y_there[:, None, :]).reshape(n, cells)

    def left(col: dict) -> list:
        gs = normals(width, seed_u, col["depth"], col["i"])
        return [outer(gs, None, *_cells(col["us"], k)), outer(gs, None, *_cells(col["ys"], width))]

    def right(col: dict) -> list:
        return [outer(*_cells(col["vs"], k), normals(width, seed_v, col["depth"], col["j"]), None)]

    lhs = block_sums(u, block, ["depth", "i", "us", "ys"], {"gu": width * k, "gy": width * width}, left).drop("n_rows")
    rhs = block_sums(v, block, ["depth", "j", "vs"], {"vg": k * width}, right).drop("n_rows")
    joined = lhs.join(rhs, block)
    fields = {f.name: f.dataType.simpleString() for f in joined.schema.fields}

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            gu = np.stack(pdf["gu"].to_numpy()).reshape(-1, width, k)
            gy = np.stack(pdf["gy"].to_numpy()).reshape(-1, width, width)
            vg = np.stack(pdf["vg"].to_numpy()).reshape(-1, k, width)
            core = np.linalg.pinv(gu, rcond=1e-12) @ gy @ np.linalg.pinv(vg, rcond=1e-12)
            yield pdf[block].assign(core=list(core.reshape(len(pdf), -1)))

    keys = ", ".join(f"{b} {fields[b]}" for b in block)
    return joined.mapInPandas(solve, f"{keys}, core array<double>")
