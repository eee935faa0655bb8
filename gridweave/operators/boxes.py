"""Box tables of the dyadic hierarchy.

Boxes are a rollup over integer cell keys: points are counted per finest occupied
cell first (combined map-side), and only those cells climb the levels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.functions.geometry import suggest_eta
from gridweave.durable import cut_lineage
from gridweave.grid import Grid
from gridweave.skew import hot_table, skew_join


def rollup(points: DataFrame, grid: Grid, depth: int, first: Sequence[Column], merge: Sequence[Column]) -> DataFrame:
    """Aggregate per cell at ``depth``, then merge the cells of every coarser depth."""
    cells = points.select(*points.columns, *grid.cells(depth)).groupBy(*grid.keys).agg(*first)
    up = cells.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    payload = [c for c in cells.columns if c not in grid.keys]
    keyed = up.select("depth", *grid.coarsen(F.lit(depth) - F.col("depth")), *payload)
    return keyed.groupBy("depth", *grid.keys).agg(*merge)


def boxes(points: DataFrame, grid: Grid, depth: int) -> DataFrame:
    """Every non-empty box of depths ``0..depth`` with its point count."""
    return rollup(points, grid, depth, [F.count(F.lit(1)).alias("n")], [F.sum("n").alias("n")])


def crowded_boxes(points: DataFrame, grid: Grid, m: int, depth: int, step: int = 4) -> DataFrame:
    """Boxes down to ``depth``, and below it those of cells that still hold ``m`` or more points, to ``grid.finest``.

    Only crowded cells go deeper, ``step`` depths at a time, so the rows follow the tree and not the finest depth.
    """
    fine = cut_lineage(points.select(*grid.cells(grid.finest)).groupBy(*grid.keys).agg(F.count(F.lit(1)).alias("n")))
    found, first, last = None, 0, min(max(depth, 1), grid.finest)
    while True:
        levels = fine.withColumn("depth", F.explode(F.sequence(F.lit(first), F.lit(last))))
        keyed = levels.select("depth", *grid.coarsen(F.lit(grid.finest) - F.col("depth")), "n")
        part = cut_lineage(keyed.groupBy("depth", *grid.keys).agg(F.sum("n").alias("n")))
        found = part if found is None else found.unionByName(part)
        crowded = part.where((F.col("depth") == last) & (F.col("n") >= max(m, 2))).select(*[F.col(k).alias(f"c_{k}") for k in grid.keys])
        if last == grid.finest or not crowded.head(1):
            return found
        at = grid.coarsen(F.lit(grid.finest - last))
        fine = cut_lineage(fine.select(*grid.keys, "n", *[c.alias(f"c_{k}") for c, k in zip(at, grid.keys)]).join(crowded, [f"c_{k}" for k in grid.keys], "left_semi").select(*grid.keys, "n"))
        first, last = last + 1, min(last + step, grid.finest)


def parent_keys(grid: Grid) -> list[Column]:
    return [(F.col("depth") - 1).cast("int").alias("depth"), *grid.coarsen(1)]


def box_children(box: DataFrame, grid: Grid) -> DataFrame:
    """Each box below the root with its parent's key and count."""
    up = [f"p_{k}" for k in grid.keys]
    child = box.where("depth > 0").select(
        "depth",
        *grid.keys,
        "n",
        (F.col("depth") - 1).cast("int").alias("p_depth"),
        *[c.alias(u) for c, u in zip(grid.coarsen(1), up)],
    )
    parent = box.select(
        F.col("depth").alias("p_depth"),
        *[F.col(k).alias(u) for k, u in zip(grid.keys, up)],
        F.col("n").alias("p_n"),
    )
    return child.join(parent, ["p_depth", *up])


def adaptive_boxes(box: DataFrame, grid: Grid, m: int, depth: int) -> DataFrame:
    """Boxes that exist when only boxes with at least ``m`` points split.

    A single point never splits, whatever ``m``; ``depth`` ends coincident points.
    """
    if m < 1:
        raise ValueError(f"m must be >= 1, got {m}")
    stop = max(m, 2)
    split = box_children(box, grid).where(F.col("p_n") >= stop).select("depth", *grid.keys, "n")
    found = box.where("depth = 0").select("depth", *grid.keys, "n").unionByName(split)
    return found.withColumn("is_leaf", (F.col("n") < stop) | (F.col("depth") == depth))


def leaf_boxes(box: DataFrame, grid: Grid, m: int, depth: int) -> DataFrame:
    return adaptive_boxes(box, grid, m, depth).where("is_leaf").drop("is_leaf")


def collapsed_boxes(box: DataFrame, grid: Grid, m: int) -> DataFrame:
    """Adaptive boxes with single-child chains removed.

    A box is kept when its parent splits and it holds fewer points than the parent.
    ``level`` counts the kept boxes strictly above it, ``up_depth`` is the depth of the
    nearest one (-1 for the root), and a leaf has no kept box below it.
    """
    if m < 1:
        raise ValueError(f"m must be >= 1, got {m}")
    stop = max(m, 2)
    kept = (
        box_children(box, grid)
        .where((F.col("p_n") >= stop) & (F.col("n") < F.col("p_n")))
        .select("depth", *grid.keys, "n")
        .unionByName(box.where("depth = 0").select("depth", *grid.keys, "n"))
    )
    own = [F.col(k).alias(f"own_{k}") for k in grid.keys]
    climb = (
        kept.where("depth > 0")
        .select(
            F.col("depth").alias("own_depth"),
            *own,
            "n",
            *grid.keys,
            F.explode(F.sequence(F.lit(0), F.col("depth") - 1)).alias("depth"),
        )
        .select(
            "own_depth", *[f"own_{k}" for k in grid.keys], "n", "depth",
            *grid.coarsen(F.col("own_depth") - F.col("depth")),
        )
    )
    own_keys = ["own_depth", *[f"own_{k}" for k in grid.keys]]
    linked = (
        climb.join(kept.select("depth", *grid.keys), ["depth", *grid.keys], "left_semi")
        .groupBy(*own_keys)
        .agg(
            F.max("n").alias("n"),
            F.count(F.lit(1)).cast("int").alias("level"),
            F.max("depth").cast("int").alias("up_depth"),
        )
        .select(
            F.col("own_depth").alias("depth"),
            *[F.col(f"own_{k}").alias(k) for k in grid.keys],
            "n", "level", "up_depth",
        )
        .unionByName(
            box.where("depth = 0").select(
                "depth", *grid.keys, "n", F.lit(0).alias("level"), F.lit(-1).alias("up_depth")
            )
        )
    )
    parents = (
        linked.where("depth > 0")
        .select(F.col("up_depth").alias("depth"), *grid.coarsen(F.col("depth") - F.col("up_depth")))
        .groupBy("depth", *grid.keys)
        .agg(F.count(F.lit(1)).alias("n_children"))
    )
    return (
        linked.join(parents, ["depth", *grid.keys], "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint")))
        .withColumn("is_leaf", F.col("n_children") == 0)
    )


def box_geometry(box: DataFrame, grid: Grid) -> DataFrame:
    """Cell edges, center and diagonal of each box."""
    out = []
    for ax, (lo, hi) in zip(grid.axes, grid.edges(F.col("depth"))):
        out += [lo.alias(f"{ax}_lo"), hi.alias(f"{ax}_hi"), ((lo + hi) * F.lit(0.5)).alias(f"{ax}_mid")]
    return box.select("depth", *grid.keys, *out, grid.diam(F.col("depth")).alias("diam"))


def box_tight_bounds(points: DataFrame, grid: Grid, depth: int) -> DataFrame:
    """Bounds of the points themselves, with center and diagonal, for every box."""
    first, merge = [F.count(F.lit(1)).alias("n")], [F.sum("n").alias("n")]
    for ax in grid.axes:
        first += [F.min(ax).alias(f"{ax}_lo"), F.max(ax).alias(f"{ax}_hi")]
        merge += [F.min(f"{ax}_lo").alias(f"{ax}_lo"), F.max(f"{ax}_hi").alias(f"{ax}_hi")]
    tight = rollup(points, grid, depth, first, merge)
    squares = F.lit(0.0)
    for ax in grid.axes:
        side = F.col(f"{ax}_hi") - F.col(f"{ax}_lo")
        squares = squares + side * side
        tight = tight.withColumn(f"{ax}_mid", (F.col(f"{ax}_lo") + F.col(f"{ax}_hi")) * F.lit(0.5))
    return tight.withColumn("diam", F.sqrt(squares))


def boxes_at_depth(box: DataFrame, depth: int) -> DataFrame:
    return box.where(F.col("depth") == depth)


def level_profile(box: DataFrame) -> DataFrame:
    """Box count and occupancy per depth."""
    return box.groupBy("depth").agg(
        F.count(F.lit(1)).alias("n_boxes"),
        F.sum("n").alias("n_points"),
        F.min("n").alias("min_n"),
        F.max("n").alias("max_n"),
    )


def leaf_membership(points: DataFrame, leaves: DataFrame, grid: Grid, depth: int) -> DataFrame:
    """Leaf box of every point.

    The leaf of each occupied finest cell is found among cells, not points; the points
    then take it over in one join on their cell, spread when a cell is hot.  ``points``
    should be stored, as it is read more than once.
    """
    fine = points.select("id", *[c.alias(f"f_{k}") for c, k in zip(grid.cells(depth), grid.keys)])
    fine_keys = [f"f_{k}" for k in grid.keys]
    up = fine.select(*fine_keys).distinct().withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    anc = [
        F.call_function("shiftright", F.col(f), (F.lit(depth) - F.col("depth")).cast("int")).alias(k)
        for f, k in zip(fine_keys, grid.keys)
    ]
    owner = up.select(*fine_keys, "depth", *anc).join(leaves.select("depth", *grid.keys), ["depth", *grid.keys])
    hot = hot_table(fine, fine_keys)
    return skew_join(fine, owner, fine_keys, ["id"], hot).select("id", "depth", *grid.keys)


def finest_needed(points: DataFrame, grid: Grid, m: int) -> int:
    """Smallest uniform depth at which no box holds more than ``m`` distinct locations.

    One scalar comes back.  Copies of a location count once, so any number of
    coincident points cannot push the depth down.
    """
    if m < 1:
        raise ValueError(f"m must be >= 1, got {m}")
    places = points.select(*grid.axes).distinct()
    # Below a cell of at most m locations no box holds more, so only crowded cells go deeper.
    fullest = level_profile(crowded_boxes(places, grid, m + 1, grid.depth_for(m))).where(F.col("max_n") <= m)
    depth = fullest.agg(F.min("depth")).first()[0]
    return grid.finest if depth is None else int(depth)


def eta_sweep(tight: DataFrame, grid: Grid, targets: Sequence[float]) -> DataFrame:
    """Suggested separation per box and target, with the box's own relative extent as gamma."""
    gamma = F.col("diam") / grid.diam(F.col("depth"))
    return (
        tight.select("depth", *grid.keys, gamma.alias("gamma"))
        .withColumn("target", F.explode(F.array(*[F.lit(float(t)) for t in targets])))
        .withColumn("eta", suggest_eta(F.col("gamma"), F.col("target"), grid.d))
    )
