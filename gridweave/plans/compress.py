"""Hierarchical compression of a matrix and products with the result.

Entry mode reads the entries: each one finds its own block from integer cell keys, so the
samples of all blocks of all depths are one aggregate.  Black-box mode only multiplies the
whole matrix with periodic sketches and peels coarser depths, as the published method does.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.durable import cut_lineage
from gridweave.functions.gaussian import gaussian_array, normals, sketch_width
from gridweave.functions.kernel import DEFAULT_EPS
from gridweave.grid import Grid
from gridweave.operators import near as near_ops
from gridweave.operators.blockfactor import BLOCK, block_orth, core_matrix, lists_of
from gridweave.operators.factors import Factors, apply_truncated, apply_truncated_t, peeled_matvec_thick
from gridweave.operators.norms import BROADCAST_STEP, matrix_products, power_norm, ratio, start_vector
from gridweave.operators.patterns import LEAF_PERIOD, SAMPLE_PERIOD, packed_probe, pattern_code
from gridweave.operators.products import matvec, rmatvec, sum_arrays, transpose
from gridweave.operators.residual import ERROR, FAR, WHOLE, located_norms
from gridweave.skew import hot_table, skew_join

# Seeds of the column and the row sketches.
COL_SEED, ROW_SEED = 11, 23
# Slots of one thick probe column.
PROBE_WIDTH = 8
# First depth that has well-separated pairs.
FIRST_DEPTH = 2
# Pairs of one depth up to this bound are broadcast; a depth has at most 2^(d depth) boxes of 6^d pairs.
BROADCAST_PAIRS = 200_000


# -- where an entry belongs ------------------------------------------------
def separation_depth(grid: Grid, depth: int, row: str = "r_", col: str = "c_", eta: float | None = None) -> Column:
    """First depth at which the cells of an entry's row and column no longer touch; null if they always do.

    With ``eta`` they must be ``eta`` cell diagonals apart instead.  Both are monotone over depths, so
    this is the one depth whose block holds the entry.
    """
    if eta is not None and eta <= 0:
        raise ValueError(f"eta must be > 0, got {eta}")
    out = None
    for level in range(FIRST_DEPTH, depth + 1):
        apart, square = F.lit(False), F.lit(0.0)
        for k, wide in zip(grid.keys, grid.width):
            r = F.shiftright(F.col(row + k), depth - level)
            c = F.shiftright(F.col(col + k), depth - level)
            apart = apart | (F.abs(r - c) > 1)
            gap = F.greatest(F.abs(r - c) - 1, F.lit(0)).cast("double") * F.lit(wide / 2.0**level)
            square = square + gap * gap
        if eta is not None:
            apart = F.sqrt(square) >= F.lit(eta) * grid.diam(F.lit(level))
        out = F.when(apart, level) if out is None else out.when(apart, level)
    return F.lit(None).cast("int") if out is None else out


def locate(matrix: DataFrame, points: DataFrame, grid: Grid, depth: int, eta: float | None = None) -> DataFrame:
    """Attach to each entry its block ``(depth, a, b)``: an interaction block, or a neighbor block
    of the last depth (``far`` false).

    With ``eta`` the far blocks are those of the metric cover (``plans.cover``), pairs of boxes that are
    the first to be ``eta`` diagonals apart.  This is the only place where entries meet the points; every later step reads the result.
    ``matrix`` should be a stored table.
    """
    cells = points.select("id", *grid.cells(depth))
    out = matrix
    for end, dof, prefix in (("i", grid.dof_row, "r_"), ("j", grid.dof_col, "c_")):
        side = cells.select(F.col("id").alias(f"{end}_id"), *[F.col(k).alias(prefix + k) for k in grid.keys])
        key, other = f"{end}_id", "j" if end == "i" else "i"
        patch = F.expr(f"{end} div {dof}")
        hot = hot_table(matrix.withColumn(key, patch), [key])
        out = skew_join(out.withColumn(key, patch), side, [key], [other], hot, follows_input=True).drop(key)
    out = out.withColumn("_sep", separation_depth(grid, depth, eta=eta))
    out = out.withColumn("depth", F.coalesce(F.col("_sep"), F.lit(depth)))
    up = F.lit(depth) - F.col("depth")

    def code(prefix: str) -> Column:
        return grid.code(F.col("depth"), cells=grid.coarsen(up, prefix))

    return out.select(
        "depth", code("r_").alias("a"), code("c_").alias("b"), "i", "j", "v", F.col("_sep").isNotNull().alias("far")
    )


def leaf_blocks(entries: DataFrame) -> DataFrame:
    """Entries of the touching blocks of the last depth, by block."""
    return entries.where(~F.col("far")).drop("far")


# -- samples ---------------------------------------------------------------
def _drawn(entries: DataFrame, keep: str, draw: str, width: int, seed: int) -> DataFrame:
    """``(block, keep, ys)``: of every well-separated entry its value times the Gaussians of its index ``draw``, added up."""
    far = entries.where("far").select(*BLOCK, "i", "j", "v")
    kinds = {f.name: f.dataType.simpleString() for f in far.schema.fields}
    names = [*BLOCK, keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = batch.column("v").cast(pa.float64())
                ys = v.fill_null(0.0).to_numpy()[:, None] * normals(width, seed, batch.column("depth"), batch.column(draw))
                made = lists_of(ys, v.is_valid().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], made], [*names, "ys"])

    rows = far.mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in names], "ys array<double>"]))
    return rows.groupBy(*names).agg(sum_arrays(width, lambda c: f"ys[{c}]").alias("ys"))


def entry_samples(entries: DataFrame, width: int, seed: int = COL_SEED) -> DataFrame:
    """Column samples ``A_ab G_b`` of every interaction block: ``(depth, a, b, i, ys)``."""
    return _drawn(entries, "i", "j", width, seed)


def entry_row_samples(entries: DataFrame, width: int, seed: int = ROW_SEED) -> DataFrame:
    """Row samples ``A_ab^T G_a``: ``(depth, a, b, j, ys)``."""
    return _drawn(entries, "j", "i", width, seed)


def _owned(points: DataFrame, grid: Grid, depth: int, dof: int, out: str) -> DataFrame:
    """``(box, pattern, out)``: matrix indices of each box at one depth."""
    cells = points.select("id", *grid.cells(depth))
    first = F.col("id") * dof
    return cells.select(
        grid.code(F.lit(depth)).alias("box"),
        pattern_code(grid, SAMPLE_PERIOD).alias("pattern"),
        F.explode(F.sequence(first, first + (dof - 1))).alias(out),
    )


def level_sample(
    matrix: DataFrame,
    points: DataFrame,
    grid: Grid,
    depth: int,
    width: int,
    factors: Factors | None = None,
    seed: int = COL_SEED,
    adjoint: bool = False,
    settled: bool = False,
) -> DataFrame:
    """Products with the periodic sketches of one depth, coarser depths peeled: ``(pattern, i, ys)``.

    All boxes of a pattern share one product.  ``adjoint`` samples the transposed matrix.  ``settled`` leaves out
    rows of which peeling leaves rounding alone.
    """
    dof = grid.dof_row if adjoint else grid.dof_col
    active = _owned(points, grid, depth, dof, "j")
    sketch = active.select("pattern", "j", gaussian_array(width, seed, str(depth), "j").alias("xs"))
    source = transpose(matrix) if adjoint else matrix
    peeled = factors.transposed() if adjoint and factors is not None else factors
    return peeled_matvec_thick(source, sketch, width, peeled, ["pattern"], ["pattern"], settled)


def level_samples(
    matrix: DataFrame, points: DataFrame, grid: Grid, depth: int, width: int, factors: Factors | None = None, seed: int = COL_SEED, adjoint: bool = False
) -> DataFrame:
    """``level_sample`` of every depth from the first with well-separated pairs to ``depth``: ``(depth, pattern, i, ys)``.

    Each depth peels the blocks of ``factors`` that are coarser than it.
    """
    out = None
    for level in range(FIRST_DEPTH, depth + 1):
        coarser = factors.above(level) if factors is not None and level > FIRST_DEPTH else None
        part = level_sample(matrix, points, grid, level, width, coarser, seed, adjoint).withColumn("depth", F.lit(level))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError(f"depth {depth} has no well-separated pairs")
    return out.select("depth", "pattern", "i", "ys")


def probe_blocks(
    matrix: DataFrame, points: DataFrame, grid: Grid, pairs: DataFrame, depth: int, factors: Factors | None, width: int = PROBE_WIDTH
) -> DataFrame:
    """Touching blocks of ``depth`` from products with packed probes alone: ``(depth, a, b, i, j, v)``.

    ``factors`` stand for all well-separated blocks down to ``depth`` and are peeled off.  What
    is left at a box's rows comes from its neighbors, and only one of them has a given pattern,
    so pattern and slot lead back to one column.  All entries of the blocks come back, zeros too.
    """
    probe = cut_lineage(packed_probe(points, grid, depth, width))
    unit = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda s: F.when(s == F.col("at"), 1.0).otherwise(0.0))
    sample = peeled_matvec_thick(matrix, probe.select("pattern", "chunk", "j", unit.alias("xs")), width, factors, ["pattern", "chunk"], ["pattern"])
    near = pairs.where((F.col("depth") == depth) & (F.col("kind") == "nei")).select(
        grid.code(F.col("depth"), "a_").alias("box"),
        grid.code(F.col("depth"), "b_").alias("b"),
        pattern_code(grid, LEAF_PERIOD, "b_").alias("pattern"),
    )
    rows = _owned(points, grid, depth, grid.dof_row, "i").drop("pattern").join(near, "box")
    slots = probe.groupBy(F.col("box").alias("b"), "chunk").agg(F.collect_list(F.struct("at", "j")).alias("slots"))
    got = rows.join(sample, ["pattern", "i"]).join(slots, ["b", "chunk"])
    return got.select(
        F.lit(depth).alias("depth"), F.col("box").alias("a"), "b", "i", "ys", F.inline("slots")
    ).select("depth", "a", "b", "i", "j", F.element_at("ys", F.col("at") + 1).alias("v"))


def block_samples(
    sample: DataFrame, pairs: DataFrame, points: DataFrame, grid: Grid, depth: int, adjoint: bool = False
) -> DataFrame:
    """Read the blocks of one depth off a level sample: rows of a box, in the pattern of its partner."""
    own, partner = ("b_", "a_") if adjoint else ("a_", "b_")
    level = pairs.where((F.col("depth") == depth) & (F.col("kind") == "int")).select(
        "depth",
        grid.code(F.col("depth"), "a_").alias("a"),
        grid.code(F.col("depth"), "b_").alias("b"),
        grid.code(F.col("depth"), own).alias("box"),
        pattern_code(grid, SAMPLE_PERIOD, partner).alias("pattern"),
    )
    rows = _owned(points, grid, depth, grid.dof_col if adjoint else grid.dof_row, "i").drop("pattern")
    # Few boxes hold all rows on a coarse depth.  The grid bounds its pairs, so they are copied to
    # the rows there; on deeper depths the boxes themselves spread the join.
    if 12**grid.d * 2 ** (grid.d * (depth - 1)) <= BROADCAST_PAIRS:
        level = F.broadcast(level)
    wanted = rows.join(level, "box").drop("box")
    got = wanted.join(sample, ["pattern", "i"]).select(*BLOCK, "i", "ys")
    return got.withColumnRenamed("i", "j") if adjoint else got


def kernel_samples(
    points: DataFrame,
    grid: Grid,
    pairs: DataFrame,
    depth: int,
    width: int,
    seed: int,
    eps: float = DEFAULT_EPS,
    adjoint: bool = False,
) -> DataFrame:
    """Samples of the kernel's interaction blocks, ``(depth, a, b, i, ys)`` or with ``adjoint`` ``(…, j, ys)``.

    Gaussians of copies are added per location before any block is formed, and a tile pair
    yields one partial row per target location.
    """
    source, target = (grid.dof_row, grid.dof_col) if adjoint else (grid.dof_col, grid.dof_row)
    far = pairs.where("kind = 'int'")
    if adjoint:
        far = far.select(
            "depth",
            *[F.col(f"b_{k}").alias(f"a_{k}") for k in grid.keys],
            *[F.col(f"a_{k}").alias(f"b_{k}") for k in grid.keys],
        )
    levels = near_ops.at_depths(points.select("id", *grid.axes), depth, FIRST_DEPTH)
    drawn = levels.select(
        "depth",
        "id",
        *grid.axes,
        *[gaussian_array(width, seed, "depth", f"id * {source} + {c}").alias(f"g{c}") for c in range(source)],
    )
    places = drawn.groupBy("depth", *grid.axes).agg(
        F.min("id").alias("loc"),
        sum_arrays(source * width, lambda at: f"g{at // width}[{at % width}]").alias("gs"),
    )
    tile = cut_lineage(near_ops.tiles(places, grid, depth, ["gs"]))
    joined = near_ops.tile_pairs(far, tile, grid)
    acc = near_ops.kernel_block_product(joined, grid, eps, width, "gs", adjoint)
    parts = F.array(
        *[
            F.struct(F.lit(c).alias("c"), F.slice("acc", c * width + 1, width).alias("ys"))
            for c in range(target)
        ]
    )
    by_patch = near_ops.to_patches(acc, points, grid, ["acc"], list(BLOCK))
    out = by_patch.select(*BLOCK, "id", F.inline(parts))
    row = (F.col("id") * target + F.col("c")).alias("i")
    if adjoint:
        return out.select("depth", F.col("b").alias("a"), F.col("a").alias("b"), row.alias("j"), "ys")
    return out.select(*BLOCK, row, "ys")


# -- factors ---------------------------------------------------------------
def factor_blocks(y: DataFrame, z: DataFrame, k: int, p: int, method: str = "svd") -> Factors:
    """Factors of all sampled blocks from their column and row samples.  The two sides do not depend on each other and run side by side."""
    width = sketch_width(k, p)

    def side(sample: DataFrame, row: str, out: str) -> DataFrame:
        return cut_lineage(block_orth(cut_lineage(sample), row, width, k, method, BLOCK, out))

    with ThreadPoolExecutor(2) as pool:
        u, v = pool.map(side, (y, z), ("i", "j"), ("us", "vs"))
    core = cut_lineage(core_matrix(u, v, width, k, ROW_SEED, COL_SEED))
    return Factors(u.drop("ys"), core, v.drop("ys"), k, hot_table(u, BLOCK), hot_table(v, BLOCK), core.count())


def column_bases(y: DataFrame, k: int, p: int, method: str = "svd") -> DataFrame:
    """Column bases of all sampled blocks: ``(depth, a, b, i, us, k_eff)``."""
    return block_orth(cut_lineage(y), "i", sketch_width(k, p), k, method, BLOCK, "us").drop("ys")


def row_bases(z: DataFrame, k: int, p: int, method: str = "svd") -> DataFrame:
    """Row bases of all sampled blocks: ``(depth, a, b, j, vs, k_eff)``."""
    return block_orth(cut_lineage(z), "j", sketch_width(k, p), k, method, BLOCK, "vs").drop("ys")


@dataclass(frozen=True)
class Compressed:
    """Touching entries ``(i, j, v)`` kept exactly, and factors of everything else."""

    near: DataFrame
    factors: Factors


def compress_entries(entries: DataFrame, k: int, p: int, method: str = "svd") -> Compressed:
    """Entry mode: all depths at once from a located matrix (a written table)."""
    width = sketch_width(k, p)
    factors = factor_blocks(entry_samples(entries, width), entry_row_samples(entries, width), k, p, method)
    return Compressed(leaf_blocks(entries).select("i", "j", "v"), factors)


def compress_kernel(
    points: DataFrame, grid: Grid, pairs: DataFrame, depth: int, k: int, p: int,
    eps: float = DEFAULT_EPS, method: str = "svd",
) -> Factors:
    """Factors of the kernel's interaction blocks; its near part stays ``kernel_pairs_matvec``."""
    width = sketch_width(k, p)
    y = kernel_samples(points, grid, pairs, depth, width, COL_SEED, eps)
    z = kernel_samples(points, grid, pairs, depth, width, ROW_SEED, eps, adjoint=True)
    return factor_blocks(y, z, k, p, method)


def compress_black_box(
    matrix: DataFrame, points: DataFrame, grid: Grid, pairs: DataFrame, depth: int, k: int, p: int, method: str = "svd",
    state: str | None = None,
) -> Factors:
    """Black-box mode: depth by depth from products with the whole matrix, coarser depths peeled.

    A block of which peeling leaves rounding alone has no factors: orthonormal columns of it would be of rank ``k``, of no
    meaning, and there are ``6^d`` such blocks for every box.

    With ``state``, a folder that all executors reach, each depth's factors are kept there; a run
    that was ended goes on behind the last whole depth.  A folder belongs to one matrix, and
    other settings than those it was begun with are an error.
    """
    width = sketch_width(k, p)
    settings = f"k={k} p={p} method={method} n={grid.n} lo={grid.lo} top={grid.top}"
    pairs = cut_lineage(pairs)
    done: Factors | None = None
    for level in range(FIRST_DEPTH, depth + 1):
        folder = f"{state}/{level}"
        new = Factors.load(matrix.sparkSession, folder, settings) if state else None
        if new is None:
            y = level_sample(matrix, points, grid, level, width, done, COL_SEED, settled=True)
            z = level_sample(matrix, points, grid, level, width, done, ROW_SEED, adjoint=True, settled=True)
            new = factor_blocks(
                block_samples(y, pairs, points, grid, level),
                block_samples(z, pairs, points, grid, level, adjoint=True),
                k, p, method,
            )
            if state:
                new.save(folder, settings)
        done = new if done is None else done.plus(new)
    if done is None:
        raise ValueError(f"depth {depth} has no well-separated pairs")
    return done


# -- products and reports --------------------------------------------------
def hier_matvec(comp: Compressed, vec: DataFrame, vec_rows: int | None = None) -> DataFrame:
    """Compressed ``A x``: touching entries exactly, the rest from factors, one final sum."""
    parts = matvec(comp.near, vec, vec_rows).unionByName(apply_truncated(comp.factors, vec, vec_rows))
    return parts.groupBy("i").agg(F.sum("y").alias("y"))


def hier_rmatvec(comp: Compressed, vec: DataFrame, vec_rows: int | None = None) -> DataFrame:
    """Compressed ``A^T x`` for ``(i, x)``, as ``(j, y)``."""
    parts = rmatvec(comp.near, vec, vec_rows).unionByName(apply_truncated_t(comp.factors, vec, vec_rows))
    return parts.groupBy("j").agg(F.sum("y").alias("y"))


def stored_numbers(comp: Compressed) -> DataFrame:
    """One row: numbers held by touching entries, bases and cores."""
    near = comp.near.agg(F.count(F.lit(1)).alias("n"))
    bases = [t.agg(F.coalesce(F.sum(F.col("k_eff").cast("bigint")), F.lit(0)).alias("n")) for t in (comp.factors.u, comp.factors.v)]
    cores = comp.factors.core.agg((F.count(F.lit(1)) * comp.factors.k * comp.factors.k).alias("n"))
    parts = [df.withColumn("part", F.lit(name)) for name, df in zip(("near", "u", "v", "core"), (near, *bases, cores))]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.agg(
        *[F.sum(F.when(F.col("part") == name, F.col("n"))).alias(f"n_{name}") for name in ("near", "u", "v", "core")]
    )


def compression_report(
    entries: DataFrame, comp: Compressed, grid: Grid, n_iters: int = 20, seed: int = 0, norms: tuple[float, float] | None = None
) -> DataFrame:
    """Relative spectral errors and sizes.

    The touching part is exact, so the error of the whole and of the far part share one
    numerator; the far error is the one to gate on, as a dominant diagonal hides it in the other.
    ``norms`` are ``entry_norms`` of the same entries where they are known.
    """
    together = located_norms(entries, comp.factors, (ERROR,) if norms else (ERROR, FAR, WHOLE), n_iters, seed)
    if together is None:
        error, (far_norm, whole_norm) = _norms_apart(entries, comp, n_iters, seed, norms)
    else:
        error = together[ERROR]
        far_norm, whole_norm = norms or (together[FAR], together[WHOLE])
    full = grid.n * grid.dof_row * grid.n * grid.dof_col
    return stored_numbers(comp).select(
        F.lit(comp.factors.k).alias("k"),
        F.lit(ratio(error, whole_norm)).alias("rel_error"),
        F.lit(ratio(error, far_norm)).alias("far_rel_error"),
        "n_near",
        "n_u",
        "n_v",
        "n_core",
        F.lit(float(full)).alias("n_full"),
    )


def _norms_apart(
    entries: DataFrame, comp: Compressed, n_iters: int, seed: int, norms: tuple[float, float] | None
) -> tuple[float, tuple[float, float]]:
    """The norm of what the factors leave, and ``entry_norms``, by products of their tables, which hold for any size."""
    start = cut_lineage(start_vector(entries.select("j").distinct(), seed))
    fwd, adj = matrix_products(cut_lineage(entries.where("far").select("i", "j", "v")))
    sizes = entries.agg(F.count_distinct("i").alias("i"), F.count_distinct("j").alias("j")).first()
    # The factors take their own copy of each vector, so both copies of a step stay within the bound of one.
    few = 2 * (sizes["i"] + sizes["j"]) <= BROADCAST_STEP
    n_i, n_j = (sizes["i"], sizes["j"]) if few else (None, None)

    def minus(full: DataFrame, approx: DataFrame, key: str) -> DataFrame:
        both = full.unionByName(approx.select(key, (-F.col("y")).alias("y")))
        return both.groupBy(key).agg(F.sum("y").alias("y"))

    # Both halves of the adjoint read the same vector, so it is written first.
    def error_norm() -> float:
        with comp.factors.dealt_out() as f:
            return power_norm(
                lambda x: cut_lineage(minus(fwd(x), apply_truncated(f, x, n_j), "i")),
                lambda x: minus(adj(x), apply_truncated_t(f, x, n_i), "j"),
                start,
                n_iters,
            )

    # The norms are chains of small jobs that do not wait for each other.
    with ThreadPoolExecutor(2) as pool:
        apart = pool.submit(error_norm)
        known = norms or entry_norms(entries, n_iters, seed)
        return apart.result(), known


def entry_norms(entries: DataFrame, n_iters: int = 20, seed: int = 0, whole: float | None = None) -> tuple[float, float]:
    """Spectral norms of the far part and of the whole of located entries (a written table), from one start vector.

    ``whole`` is the second one where it is known.
    """
    found = located_norms(entries, None, (FAR, WHOLE) if whole is None else (FAR,), n_iters, seed)
    if found is not None:
        return found[FAR], found.get(WHOLE, whole)
    start = cut_lineage(start_vector(entries.select("j").distinct(), seed))

    def norm(part: DataFrame) -> float:
        return power_norm(*matrix_products(cut_lineage(part.select("i", "j", "v"))), start, n_iters)

    with ThreadPoolExecutor(2) as pool:
        far = pool.submit(norm, entries.where("far"))
        whole = norm(entries) if whole is None else whole
        return far.result(), whole


def param_sweep(
    matrix: DataFrame, points: DataFrame, grid: Grid, settings: Sequence[tuple], n_iters: int = 20, at_once: int = 4
) -> DataFrame:
    """Reports over ``(k, p, leaf size)`` or ``(k, p, leaf size, eta)``; ``eta`` None takes the blocks of touching cells.

    Entries are located, and their norms taken, once per leaf size and eta.  Settings do not
    depend on each other: ``at_once`` of them are run side by side, as their power steps are many small jobs.
    """
    if not settings:
        raise ValueError("no settings given")
    wanted = [(*s, None)[:4] for s in settings]
    depths = {leaf: max(grid.depth_for(leaf), FIRST_DEPTH) for _, _, leaf, _ in wanted}
    meshes = list(dict.fromkeys((depths[leaf], eta) for _, _, leaf, eta in wanted))
    located = {mesh: cut_lineage(locate(matrix, points, grid, *mesh)) for mesh in meshes}

    def report(setting: tuple) -> DataFrame:
        k, p, leaf, eta = setting
        entries = located[depths[leaf], eta]
        row = compression_report(entries, compress_entries(entries, k, p), grid, n_iters, norms=norms[depths[leaf], eta])
        named = {"p": F.lit(p), "leaf": F.lit(leaf), "eta": F.lit(eta).cast("double"), "depth": F.lit(depths[leaf])}
        return row.withColumns(named)

    with ThreadPoolExecutor(at_once) as pool:
        # All meshes hold the same matrix.
        first = entry_norms(located[meshes[0]], n_iters)
        rest = pool.map(lambda mesh: entry_norms(located[mesh], n_iters, whole=first[1]), meshes[1:])
        norms = dict(zip(meshes, [first, *rest]))
        rows = list(pool.map(report, wanted))
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out
