"""Covers of all pairs of points by pairs of boxes, found from the root down.

A pair of boxes that are apart is a block; of two leaves that are not, the pair is a near
block; any other pair is split into the pairs of its children, where a leaf stays as it is.
Only pairs that are not apart are split, depth by depth, so rows follow the blocks and not
the square of the boxes.  What is apart is a choice: by cell keys, which gives the lists of
uneven trees, or by a metric rule, whose ``eta`` then shapes the blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.durable import cut_lineage
from gridweave.functions.geometry import box_gap, is_admissible
from gridweave.grid import Grid
from gridweave.skew import shuffled

NEAR = "near"

Apart = Callable[[Grid], Column]


def cells_apart(grid: Grid) -> Column:
    """Cells of any two depths that do not touch."""
    fine = F.greatest("a_depth", "b_depth")
    out = F.lit(False)

    def scaled(cell: Column, side: str) -> Column:
        return F.call_function("shiftleft", cell, (fine - F.col(f"{side}_depth")).cast("int"))

    for k in grid.keys:
        a, b = F.col(f"a_{k}"), F.col(f"b_{k}")
        out = out | (scaled(b, "b") > scaled(a + 1, "a")) | (scaled(a, "a") > scaled(b + 1, "b"))
    return out


def metric_apart(eta: float) -> Apart:
    """Boxes whose gap is at least ``eta`` times the larger diagonal; touching boxes never are."""
    if eta <= 0:
        raise ValueError(f"eta must be > 0, got {eta}")

    def rule(grid: Grid) -> Column:
        a, b = F.col("a_depth"), F.col("b_depth")
        gap = box_gap(grid.edges(a, "a_"), grid.edges(b, "b_"))
        return is_admissible(gap, grid.diam(a), grid.diam(b), eta)

    return rule


def pair_cover(tree: DataFrame, grid: Grid, apart: Apart = cells_apart) -> DataFrame:
    """Blocks ``(a_depth, a_keys, b_depth, b_keys, n_a, n_b, kind)`` that hold every ordered pair of points once.

    ``tree`` has ``depth, keys, n, is_leaf``: every box down to its leaves (``adaptive_boxes``, or all
    boxes of a uniform depth with the last one as leaves).  ``apart`` does not ask which side is which:
    pairs are split and written one way, and turned when they are read.  ``kind`` is ``near``, ``far`` (boxes of
    one depth), ``coarse`` (a leaf and a finer box) or ``fine`` (the other way round).  One table is
    written per depth.
    """
    keys = list(grid.keys)
    tree = cut_lineage(tree.select("depth", *keys, "n", "is_leaf"))

    def side(prefix: str) -> list[Column]:
        return [F.col(c).alias(prefix + c) for c in ("depth", *keys, "n", "is_leaf")]

    up = [c.alias(f"u_{k}") for c, k in zip(grid.coarsen(1), keys)]
    kids = tree.where("depth > 0").select((F.col("depth") - 1).cast("int").alias("u_depth"), *up, F.struct("depth", *keys, "n", "is_leaf").alias("kid"))
    # A box has at most 2^d children.
    family = cut_lineage(kids.groupBy("u_depth", *[f"u_{k}" for k in keys]).agg(F.collect_list("kid").alias("kids")))

    held = ("depth", *keys, "n", "is_leaf")

    def kids_of(prefix: str) -> DataFrame:
        return shuffled(family.select(*[F.col(f"u_{c}").alias(prefix + c) for c in ("depth", *keys)], F.col("kids").alias(f"{prefix}kids")))

    def split(open_: DataFrame) -> DataFrame:
        """Pairs with each side replaced by its children, a leaf by itself; of a box with itself, each pair of children once.

        Both joins move the open pairs, which are expanded behind the second one.
        """
        for prefix in ("a_", "b_"):
            open_ = open_.join(kids_of(prefix), [prefix + c for c in ("depth", *keys)], "left")

        def parts(prefix: str) -> Column:
            own = F.array(F.struct(*[F.col(prefix + c).alias(c) for c in held]))
            return F.when(F.col(f"{prefix}is_leaf"), own).otherwise(F.col(f"{prefix}kids"))

        both = open_.select(_same(keys).alias("same"), F.explode(parts("a_")).alias("a"), parts("b_").alias("b"))
        new = both.select("same", "a", F.explode("b").alias("b"))
        order = [F.struct(*[F.col(f"{side}.{k}") for k in keys]) for side in ("a", "b")]
        new = new.where(~F.col("same") | (order[0] <= order[1]))
        return new.select(*[F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("a", "b") for c in held])

    root = tree.where("depth = 0")
    level = root.select(*side("a_"), *side("b_"))
    found = None
    for _ in range(grid.finest + 1):
        kind = (
            F.when(apart(grid), F.when(F.col("a_depth") == F.col("b_depth"), "far").when(F.col("a_depth") < F.col("b_depth"), "coarse").otherwise("fine"))
            .when(F.col("a_is_leaf") & F.col("b_is_leaf"), NEAR)
        )
        level = cut_lineage(level.withColumn("kind", kind))
        done = level.where("kind IS NOT NULL")
        found = done if found is None else found.unionByName(done)
        open_ = level.where("kind IS NULL").drop("kind")
        if not open_.head(1):
            break
        level = split(open_)
    return _both_ways(found, keys)


def _same(keys: list[str]) -> Column:
    """Whether both sides of a pair are one box."""
    out = F.col("a_depth") == F.col("b_depth")
    for k in keys:
        out = out & (F.col(f"a_{k}") == F.col(f"b_{k}"))
    return out


def _both_ways(found: DataFrame, keys: list[str]) -> DataFrame:
    """Each pair of two boxes as two ordered pairs, a box with itself as one."""
    names = ("depth", *keys)
    there = [F.col(f"{side}_{c}").alias(f"{side}_{c}") for side in ("a", "b") for c in names]
    back = [F.col(f"{other}_{c}").alias(f"{side}_{c}") for side, other in (("a", "b"), ("b", "a")) for c in names]
    turned = F.when(F.col("kind") == "coarse", "fine").when(F.col("kind") == "fine", "coarse").otherwise(F.col("kind"))
    one = F.struct(*there, F.col("a_n").alias("n_a"), F.col("b_n").alias("n_b"), F.col("kind"))
    other = F.struct(*back, F.col("b_n").alias("n_a"), F.col("a_n").alias("n_b"), turned.alias("kind"))
    return found.select(F.inline(F.when(_same(keys), F.array(one)).otherwise(F.array(one, other))))


def uniform_tree(box: DataFrame, depth: int) -> DataFrame:
    """All boxes with those of ``depth`` as leaves."""
    return box.where(F.col("depth") <= depth).withColumn("is_leaf", F.col("depth") == depth)


def cover_audit(cover: DataFrame, grid: Grid) -> DataFrame:
    """Point pairs in all blocks against the square of the points."""
    held = F.col("n_a").cast("decimal(38,0)") * F.col("n_b").cast("decimal(38,0)")
    n = F.lit(grid.n).cast("decimal(38,0)")
    out = cover.agg(F.sum(held).cast("decimal(38,0)").alias("covered")).withColumn("expected", (n * n).cast("decimal(38,0)"))
    return out.withColumn("complete", F.col("covered") == F.col("expected"))


def cover_census(cover: DataFrame) -> DataFrame:
    """Blocks and the point pairs they hold, per kind and depths.

    Blocks of equal sizes are counted first, so that decimals are made per size and not per block.
    """
    by = ["kind", "a_depth", "b_depth"]
    sizes = cover.groupBy(*by, "n_a", "n_b").agg(F.count(F.lit(1)).alias("_blocks"))
    wide = "decimal(38,0)"
    held = F.col("n_a").cast(wide) * F.col("n_b").cast(wide) * F.col("_blocks").cast("decimal(20,0)")
    return sizes.groupBy(*by).agg(F.sum("_blocks").alias("n_blocks"), F.sum(held.cast(wide)).cast(wide).alias("n_pairs"))
