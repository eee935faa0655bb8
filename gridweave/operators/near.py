"""Work on touching cells and on kernel blocks.

Points are merged to distinct locations first, so any number of copies of a location is
one row with a count.  The depth is chosen from the fullest box (``finest_needed``), which
bounds the locations a cell join can meet.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.durable import cut_lineage
from gridweave.functions.geometry import distance
from gridweave.functions.kernel import DEFAULT_EPS, kernel_block, kernel_tile
from gridweave.grid import Grid
from gridweave.operators.pairs import _shifted, half_offsets
from gridweave.operators.products import sum_arrays
from gridweave.operators.scan import running_total
from gridweave.skew import hot_table, skew_join

# Locations per tile of a dense kernel product.
TILE = 256
# Locations of one cell from which its pairs are spread.
CROWDED = 5_000


def locations(points: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Distinct locations: smallest id as ``loc``, and the number of ``copies``."""
    return points.groupBy(*axes).agg(F.min("id").alias("loc"), F.count(F.lit(1)).alias("copies"))


def _met(place: DataFrame, keys: Sequence[str], axes: Sequence[str]) -> DataFrame:
    """Unordered pairs of distinct locations in equal or touching cells, as ``a_*`` and ``b_*``.

    ``place`` is written first: both sides read it, and crowded cells are found in it, whose
    pairs are spread over many tasks.
    """
    place = cut_lineage(place)
    hot = hot_table(place, keys, CROWDED)
    cols = ["loc", "copies", *axes]
    right = place.select(*keys, *[F.col(c).alias(f"b_{c}") for c in cols])
    left = place.select(*keys, *[F.col(c).alias(f"a_{c}") for c in cols])
    offsets = [(0,) * len(keys), *half_offsets(len(keys))]
    moved = _shifted(left.withColumn("_own", F.lit(0)), keys, "m_", offsets)
    moved = moved.withColumn(
        "_own", sum([F.abs(F.col(k) - F.col(f"m_{k}")) for k in keys], F.lit(0)) == 0
    ).drop(*keys)
    for k in keys:
        moved = moved.withColumnRenamed(f"m_{k}", k)
    met = skew_join(moved, right, keys, ["a_loc"], hot).where(~F.col("_own") | (F.col("a_loc") < F.col("b_loc")))
    return met.drop("_own", *keys)


def distance_join(points: DataFrame, axes: Sequence[str], radius: float) -> DataFrame:
    """Pairs of distinct locations within ``radius``: ``a < b``, copies of each, distance.

    Cells have the radius as side, so partners lie in touching cells and the join is an
    equi-join on cell keys.
    """
    if radius <= 0:
        raise ValueError(f"radius must be > 0, got {radius}")
    keys = [f"i{c}" for c in "xyz"[: len(axes)]]
    place = locations(points, axes).select(
        "*", *[F.floor(F.col(ax) / F.lit(radius)).cast("bigint").alias(k) for ax, k in zip(axes, keys)]
    )
    gap = distance([F.col(f"a_{ax}") for ax in axes], [F.col(f"b_{ax}") for ax in axes])
    near = _met(place, keys, axes).withColumn("distance", gap).where(F.col("distance") <= F.lit(radius))
    flip = F.col("a_loc") > F.col("b_loc")
    return near.select(
        F.least("a_loc", "b_loc").alias("a"),
        F.greatest("a_loc", "b_loc").alias("b"),
        F.when(flip, F.col("b_copies")).otherwise(F.col("a_copies")).alias("a_copies"),
        F.when(flip, F.col("a_copies")).otherwise(F.col("b_copies")).alias("b_copies"),
        "distance",
    )


def kernel_entries(points: DataFrame, grid: Grid, depth: int, eps: float = DEFAULT_EPS) -> DataFrame:
    """Kernel blocks of the touching cells at ``depth``, per ordered pair of locations.

    All copies of a location share its rows and columns, so a location pair with its two
    counts stands for every patch pair.  The block is even in ``x - y``: one evaluation
    serves both directions.
    """
    axes, keys = grid.axes, grid.keys
    place = locations(points, axes).select("*", *grid.cells(depth))
    met = _met(place, keys, axes)
    block = kernel_block([F.col(f"a_{ax}") for ax in axes], [F.col(f"b_{ax}") for ax in axes], eps)
    names = [f"k{r}{c}" for r, c, _ in block]
    one_way = met.select("a_loc", "b_loc", "a_copies", "b_copies", *[v.alias(n) for n, (_, _, v) in zip(names, block)])
    ends = F.array(
        F.struct(F.col("a_loc").alias("a"), F.col("b_loc").alias("b"), F.col("a_copies"), F.col("b_copies")),
        F.struct(
            F.col("b_loc").alias("a"),
            F.col("a_loc").alias("b"),
            F.col("b_copies").alias("a_copies"),
            F.col("a_copies").alias("b_copies"),
        ),
    )
    both = one_way.select(*names, F.inline(ends)).select("a", "b", "a_copies", "b_copies", *names)
    zero = [F.lit(0.0)] * grid.d
    own_block = kernel_block(zero, zero, eps)
    own = locations(points, axes).select(
        F.col("loc").alias("a"),
        F.col("loc").alias("b"),
        F.col("copies").alias("a_copies"),
        F.col("copies").alias("b_copies"),
        *[v.alias(n) for n, (_, _, v) in zip(names, own_block)],
    )
    return both.unionByName(own)


def at_depths(df: DataFrame, depth: int, from_depth: int = 0) -> DataFrame:
    return df.withColumn("depth", F.explode(F.sequence(F.lit(from_depth), F.lit(depth))))


def tiles(places: DataFrame, grid: Grid, depth: int, payload: Sequence[str]) -> DataFrame:
    """Locations of every box packed into rows of at most ``TILE`` members.

    ``places`` has ``depth`` (at most the given one), ``loc``, the axes and the payload
    columns.  A hot box becomes many tiles.
    """
    fine = places.select("depth", "loc", *grid.axes, *payload, *grid.cells(depth))
    boxed = fine.select(
        "depth", "loc", *grid.axes, *payload, *grid.coarsen(F.lit(depth) - F.col("depth"))
    ).withColumn("box", grid.code(F.col("depth")))
    ranked = running_total(boxed, ["depth", "box"], "loc", F.lit(1), "_rank")
    at = ", ".join(f"m.{ax}" for ax in grid.axes)
    return (
        ranked.withColumn("tile", F.floor(F.col("_rank") / F.lit(TILE)).cast("int"))
        .groupBy("depth", "box", "tile")
        .agg(F.collect_list(F.struct("loc", *grid.axes, *payload)).alias("m"))
        .select(
            "depth",
            "box",
            "tile",
            F.col("m.loc").alias("locs"),
            F.expr(f"flatten(transform(m, m -> array({at})))").alias("at"),
            *[F.flatten(F.col(f"m.{name}")).alias(name) for name in payload],
        )
    )


def tile_pairs(pairs: DataFrame, tile: DataFrame, grid: Grid) -> DataFrame:
    """Both tiles of every tile pair of the given box pairs, joined on box and tile keys.

    Tile numbers are attached to the light pair rows first, so the heavy rows meet on
    (box, tile) and a hot box is spread over its tiles.
    """
    depth = F.col("depth")
    counts = tile.groupBy("depth", "box").agg(F.count(F.lit(1)).cast("int").alias("tiles"))
    light = pairs.select("depth", grid.code(depth, "a_").alias("a"), grid.code(depth, "b_").alias("b"))
    for side in ("a", "b"):
        light = light.join(counts.select("depth", F.col("box").alias(side), F.col("tiles").alias(f"{side}_n")), ["depth", side])
        light = light.withColumn(f"{side}_tile", F.explode(F.sequence(F.lit(0), F.col(f"{side}_n") - 1))).drop(f"{side}_n")
    held = [c for c in tile.columns if c not in ("depth", "box", "tile")]
    # A tile pair is few bytes and much work: its partitions keep the session's number, however few bytes they hold.
    tasks = int(tile.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for side in ("a", "b"):
        heavy = tile.select(
            "depth",
            F.col("box").alias(side),
            F.col("tile").alias(f"{side}_tile"),
            *[F.col(c).alias(f"{side}_{c}") for c in held],
        )
        keys = ["depth", side, f"{side}_tile"]
        light = (light.repartition(tasks, *keys) if side == "b" else light).join(heavy, keys)
    return light


def kernel_block_product(joined: DataFrame, grid: Grid, eps: float, width: int, source: str, adjoint: bool) -> DataFrame:
    """Per block, kernel times the source weights, summed per target location.

    ``joined`` comes from ``tile_pairs`` and its tiles carry ``source``, ``dof * width``
    weights per location.  A tile pair yields one partial row per target, never one per pair
    of points; Spark adds up the partial rows.  The result has ``(depth, a, b, loc, acc)``,
    ``loc`` in ``a``; ``adjoint`` applies the transposed blocks, so weights follow the row
    components and sums the column components.
    """
    d, dof = grid.d, (grid.dof_col if adjoint else grid.dof_row)
    weights = grid.dof_row if adjoint else grid.dof_col
    # The block is even in x - y, so its transpose swaps components only.
    rule = "iajc,jaw->icw" if adjoint else "iajc,jcw->iaw"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = []
            for at, other, weight in zip(pdf["a_at"], pdf["b_at"], pdf["w"]):
                k = kernel_tile(np.reshape(at, (-1, d)), np.reshape(other, (-1, d)), eps)
                parts.append(np.einsum(rule, k, np.reshape(weight, (-1, weights, width)), optimize=True).ravel())
            yield pdf[["depth", "a", "b", "a_locs"]].assign(part=parts)

    need = joined.select("depth", "a", "b", "a_locs", "a_at", "b_at", F.col(f"b_{source}").alias("w"))
    parts = need.mapInPandas(run, "depth int, a long, b long, a_locs array<long>, part array<double>")
    rows = parts.select("depth", "a", "b", "part", F.posexplode("a_locs").alias("pos", "loc"))
    size = dof * width
    return rows.groupBy("depth", "a", "b", "loc").agg(
        sum_arrays(size, lambda c: f"part[pos * {size} + {c}]").alias("acc")
    )


def weights_by_location(points: DataFrame, grid: Grid, vec: DataFrame) -> DataFrame:
    """Add up a vector ``(j, x)`` over the copies of each location: ``(loc, axes, ws)``."""
    dof = grid.dof_col
    own = vec.select(F.expr(f"j div {dof}").alias("id"), (F.col("j") % dof).alias("c"), "x")
    per_patch = own.groupBy("id").agg(*[F.sum(F.when(F.col("c") == c, F.col("x"))).alias(f"w{c}") for c in range(dof)])
    weighted = points.select("id", *grid.axes).join(per_patch, "id", "left")
    return weighted.groupBy(*grid.axes).agg(
        F.min("id").alias("loc"),
        F.array(*[F.coalesce(F.sum(f"w{c}"), F.lit(0.0)) for c in range(dof)]).alias("ws"),
    )


def kernel_pairs_by_location(
    points: DataFrame, grid: Grid, pairs: DataFrame, depth: int, vec: DataFrame, eps: float = DEFAULT_EPS, from_depth: int = 0
) -> DataFrame:
    """The kernel blocks of the given box pairs, of depths ``from_depth`` to ``depth``, times ``(j, x)``, per location: ``(loc, ys)``."""
    places = at_depths(weights_by_location(points, grid, vec), depth, from_depth)
    tile = tiles(places, grid, depth, ["ws"])
    blocks = kernel_block_product(tile_pairs(pairs, tile, grid), grid, eps, 1, "ws", adjoint=False)
    return blocks.groupBy("loc").agg(sum_arrays(grid.dof_row, lambda c: f"acc[{c}]").alias("ys"))


def location_rows(per_loc: DataFrame, points: DataFrame, grid: Grid) -> DataFrame:
    """Values ``ys`` of locations as rows ``(i, y)`` of all their patches."""
    return (
        to_patches(per_loc, points, grid, ["ys"])
        .select("id", F.posexplode("ys").alias("r", "y"))
        .select((F.col("id") * grid.dof_row + F.col("r")).alias("i"), "y")
    )


def kernel_pairs_matvec(
    points: DataFrame, grid: Grid, pairs: DataFrame, depth: int, vec: DataFrame, eps: float = DEFAULT_EPS
) -> DataFrame:
    """The kernel blocks of the given box pairs times a vector ``(j, x)``, as ``(i, y)``."""
    return location_rows(kernel_pairs_by_location(points, grid, pairs, depth, vec, eps), points, grid)


def covering(pairs: DataFrame, depth: int) -> DataFrame:
    """The pairs that cover every pair of points once: interactions, and neighbors of the last depth."""
    return pairs.where((F.col("kind") == "int") | (F.col("depth") == depth))


def kernel_matvec(
    points: DataFrame, grid: Grid, pairs: DataFrame, depth: int, vec: DataFrame, eps: float = DEFAULT_EPS
) -> DataFrame:
    """The whole kernel matrix times a vector ``(j, x)``, exactly, as ``(i, y)``.

    ``pairs`` holds all neighbor and interaction pairs down to ``depth``.  Weights of copies
    are added up before any block is formed.  Exact products evaluate the kernel once per
    location pair, as the definition asks; ``plans.compress`` replaces the far part.
    """
    return kernel_pairs_matvec(points, grid, covering(pairs, depth), depth, vec, eps)


def to_patches(per_loc: DataFrame, points: DataFrame, grid: Grid, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Give every patch the values of its location: ``(by, id, values)``."""
    owner = locations(points, grid.axes).drop("copies")
    at_loc = per_loc.join(owner, "loc").select(*grid.axes, *by, *values)
    patch = points.select("id", *grid.axes)
    patches = skew_join(patch, at_loc, grid.axes, ["id"], hot_table(patch, grid.axes))
    return patches.select(*by, "id", *values)
