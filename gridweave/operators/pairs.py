"""Same-depth box pairs: neighbors and well-separated pairs.

Both kinds of a depth are the children of neighboring parents, so one equi-join of
parents on shifted cell keys yields every pair.  Offsets are taken from one half-space
and mirrored after the join, which halves the shuffled side.  A parent has at most
``2^d`` children, so a parent row is small by construction.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.functions.geometry import DEFAULT_ETA, box_gap, cells_adjacent, is_admissible
from gridweave.grid import Grid


def half_offsets(d: int) -> list[tuple[int, ...]]:
    """Lexicographically positive offsets in ``{-1, 0, 1}^d``."""
    return [o for o in product((-1, 0, 1), repeat=d) if o > (0,) * d]


def _shifted(df: DataFrame, keys: Sequence[str], prefix: str, offsets: Sequence[tuple[int, ...]]) -> DataFrame:
    """Copy rows to their offset cells: columns ``prefix + key`` hold the shifted key."""
    moves = F.array(*[F.struct(*[F.lit(v).cast("bigint").alias(k) for k, v in zip(keys, o)]) for o in offsets])
    return df.withColumn("_o", F.explode(moves)).select(
        *df.columns, *[(F.col(k) + F.col(f"_o.{k}")).alias(prefix + k) for k in keys]
    )


def _sides(keys: Sequence[str]) -> tuple[list[str], list[str]]:
    return [f"a_{k}" for k in keys], [f"b_{k}" for k in keys]


def _combine(df: DataFrame, grid: Grid, mirror: bool) -> DataFrame:
    """Unpack two child lists ``ka`` and ``kb`` into pair rows, both ways round when ``mirror``."""
    keys = grid.keys
    rows = df.withColumn("ka", F.explode("ka")).withColumn("kb", F.explode("kb"))
    if mirror:
        both = F.array(F.struct(F.col("ka").alias("p"), F.col("kb").alias("q")), F.struct(F.col("kb").alias("p"), F.col("ka").alias("q")))
        rows = rows.withColumn("_w", F.explode(both)).select("depth", F.col("_w.p").alias("ka"), F.col("_w.q").alias("kb"))
    return rows.select(
        "depth",
        *[F.col(f"ka.{k}").alias(f"a_{k}") for k in keys],
        *[F.col(f"kb.{k}").alias(f"b_{k}") for k in keys],
        F.col("ka.n").alias("n_a"),
        F.col("kb.n").alias("n_b"),
    )


def block_pairs(box: DataFrame, grid: Grid) -> DataFrame:
    """All neighbor (``nei``) and well-separated (``int``) ordered pairs of every depth.

    The root has one pair, with itself.
    """
    keys = list(grid.keys)
    up = [f"u_{k}" for k in keys]
    kids = (
        box.where("depth > 0")
        .select("depth", *[c.alias(u) for c, u in zip(grid.coarsen(1), up)], F.struct(*keys, "n").alias("kid"))
        .groupBy("depth", *up)
        .agg(F.collect_list("kid").alias("kb"))
    )
    right = kids.select("depth", *[F.col(u).alias(k) for u, k in zip(up, keys)], "kb")
    left = right.withColumnRenamed("kb", "ka")
    moved = _shifted(left, keys, "m_", half_offsets(grid.d)).select(
        "depth", "ka", *[F.col(f"m_{k}").alias(k) for k in keys]
    )
    across = _combine(moved.join(right, ["depth", *keys]).select("depth", "ka", "kb"), grid, True)
    within = _combine(left.select("depth", "ka", F.col("ka").alias("kb")), grid, False)
    a, b = _sides(keys)
    near = cells_adjacent([F.col(c) for c in a], [F.col(c) for c in b])
    pairs = across.unionByName(within).withColumn("kind", F.when(near, F.lit("nei")).otherwise(F.lit("int")))
    root = box.where("depth = 0").select(
        "depth",
        *[F.col(k).alias(c) for k, c in zip(keys, a)],
        *[F.col(k).alias(c) for k, c in zip(keys, b)],
        F.col("n").alias("n_a"),
        F.col("n").alias("n_b"),
        F.lit("nei").alias("kind"),
    )
    return pairs.unionByName(root)


def neighbor_pairs(box: DataFrame, grid: Grid) -> DataFrame:
    """Touching pairs of one depth, the box itself included."""
    keys = list(grid.keys)
    side_b = box.select("depth", *keys, F.col("n").alias("n_b"))
    side_a = box.select("depth", *keys, F.col("n").alias("n_a"))
    moved = _shifted(side_a, keys, "b_", half_offsets(grid.d)).select(
        "depth", *[F.col(k).alias(f"a_{k}") for k in keys], "n_a", *[F.col(f"b_{k}").alias(k) for k in keys]
    )
    a, b = _sides(keys)
    one_way = moved.join(side_b, ["depth", *keys]).select(
        "depth", *a, *[F.col(k).alias(c) for k, c in zip(keys, b)], "n_a", "n_b"
    )
    ends = F.array(
        F.struct(*a, *b, "n_a", "n_b"),
        F.struct(
            *[F.col(y).alias(x) for x, y in zip(a, b)],
            *[F.col(x).alias(y) for x, y in zip(a, b)],
            F.col("n_b").alias("n_a"),
            F.col("n_a").alias("n_b"),
        ),
    )
    both = one_way.select("depth", F.inline(ends))
    own = box.select(
        "depth",
        *[F.col(k).alias(c) for k, c in zip(keys, a)],
        *[F.col(k).alias(c) for k, c in zip(keys, b)],
        F.col("n").alias("n_a"),
        F.col("n").alias("n_b"),
    )
    return both.unionByName(own)


def interaction_pairs(box: DataFrame, grid: Grid) -> DataFrame:
    """Well-separated pairs: children of neighboring parents that do not touch."""
    return block_pairs(box, grid).where("kind = 'int'").drop("kind")


def interaction_list(box: DataFrame, grid: Grid, depth: int, cell: Sequence[int]) -> DataFrame:
    """Interaction list of one box; only boxes that can be in it are read on."""
    if len(cell) != grid.d:
        raise ValueError(f"cell must have {grid.d} coordinates, got {len(cell)}")
    near = box.where(F.col("depth") == depth)
    own = F.lit(True)
    for k, c in zip(grid.keys, cell):
        first = 2 * (c // 2) - 2
        near = near.where(F.col(k).between(first, first + 5))
        own = own & (F.abs(F.col(k) - c) <= 1)
    if depth == 0:
        near = near.limit(0)
    return near.where(~own).select("depth", *grid.keys, "n")


def pair_geometry(pairs: DataFrame, grid: Grid, eta: float = DEFAULT_ETA) -> DataFrame:
    """Gap distance and admissibility of each pair of cells."""
    depth = F.col("depth")
    gap = box_gap(grid.edges(depth, "a_"), grid.edges(depth, "b_"))
    diam = grid.diam(depth)
    return pairs.withColumn("gap", gap).withColumn("admissible", is_admissible(F.col("gap"), diam, diam, eta))


def block_census(box: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs per depth and kind, with the ordered pairs that belong to coarser depths as ``absent``."""
    per_depth = box.groupBy("depth").agg(F.count(F.lit(1)).alias("n_boxes"))
    counted = pairs.groupBy("depth").agg(
        F.count_if(F.col("kind") == "nei").alias("nei"), F.count_if(F.col("kind") == "int").alias("int")
    )
    return per_depth.join(counted, "depth").select(
        "depth",
        "n_boxes",
        "nei",
        "int",
        # The square of 3 billion boxes is beyond a long.
        (F.col("n_boxes").cast("decimal(19,0)") * F.col("n_boxes").cast("decimal(19,0)") - F.col("nei") - F.col("int")).cast("decimal(38,0)").alias("absent"),
    )


def admissibility_audit(pairs: DataFrame, grid: Grid, eta: float = DEFAULT_ETA) -> DataFrame:
    """How the combinatorial kind and the metric predicate agree, per depth."""
    return pair_geometry(pairs, grid, eta).groupBy("depth", "kind", "admissible").agg(F.count(F.lit(1)).alias("n_pairs"))


def coverage_audit(pairs: DataFrame, grid: Grid, depth: int) -> DataFrame:
    """Point pairs covered by all interaction blocks plus the neighbor blocks of the last depth."""
    held = F.col("n_a").cast("decimal(38,0)") * F.col("n_b").cast("decimal(38,0)")
    n = F.lit(grid.n).cast("decimal(38,0)")
    return (
        pairs.where((F.col("kind") == "int") | (F.col("depth") == depth))
        .agg(F.sum(held).cast("decimal(38,0)").alias("covered"))
        .select("covered", (n * n).cast("decimal(38,0)").alias("expected"))
        .withColumn("complete", F.col("covered") == F.col("expected"))
    )


def sampling_constraints(pairs: DataFrame, grid: Grid) -> DataFrame:
    """Per interaction pair, the boxes whose columns must be zero in its sample.

    The zero set is alpha's whole list without beta.  The list has at most ``6^d``
    boxes by the grid, and is stored once per pair as an array of box codes.
    """
    keys = grid.keys
    depth = F.col("depth")
    coded = pairs.select(
        "depth", grid.code(depth, "a_").alias("alpha"), grid.code(depth, "b_").alias("beta"), "kind"
    )
    lists = coded.groupBy("depth", "alpha").agg(
        F.array_sort(F.collect_set("beta")).alias("list"),
        F.collect_list(F.when(F.col("kind") == "int", F.col("beta"))).alias("betas"),
    )
    return lists.select("depth", "alpha", "list", F.explode("betas").alias("beta")).select(
        "depth", "alpha", "beta", F.array_except("list", F.array("beta")).alias("zero_boxes")
    )


def constraint_columns(pairs: DataFrame, box_cols: DataFrame, grid: Grid) -> DataFrame:
    """Random and zero column counts and index sums of each constraint.

    ``box_cols(depth, b_code, n_cols, col_sum)`` is one row per box.  Both sums come from
    the list's total minus the random box, so no column is listed to be counted.
    """
    depth = F.col("depth")
    coded = pairs.select(
        "depth", grid.code(depth, "a_").alias("alpha"), grid.code(depth, "b_").alias("beta"), "kind"
    )
    held = coded.join(box_cols.withColumnRenamed("code", "beta"), ["depth", "beta"])
    lists = held.groupBy("depth", "alpha").agg(
        F.sum("n_cols").alias("all_cols"),
        F.sum("col_sum").alias("all_sum"),
        F.collect_list(F.when(F.col("kind") == "int", F.struct("beta", "n_cols", "col_sum"))).alias("betas"),
    )
    return lists.select("depth", "alpha", "all_cols", "all_sum", F.inline("betas")).select(
        "depth",
        "alpha",
        "beta",
        F.col("n_cols").alias("n_random"),
        F.col("col_sum").alias("random_sum"),
        (F.col("all_cols") - F.col("n_cols")).alias("n_zero"),
        (F.col("all_sum") - F.col("col_sum")).alias("zero_sum"),
    )


def constraint_conflicts(pairs: DataFrame, grid: Grid) -> DataFrame:
    """Per box: distinct constraint sets, and conflicts that meet at the box.

    A set is a random box with the rest of its list zero, so equal lists give equal sets
    and are merged first.  Two sets conflict where one needs a box random that the other
    needs zero; the conflicts at a box are the product of both counts, so no set pairs
    are listed.  At most ``6^d`` boxes share a list.
    """
    depth = F.col("depth")
    coded = pairs.select(
        "depth", grid.code(depth, "a_").alias("alpha"), grid.code(depth, "b_").alias("beta"), "kind"
    )
    lists = (
        coded.groupBy("depth", "alpha")
        .agg(
            F.array_sort(F.collect_set("beta")).alias("list"),
            F.collect_list(F.when(F.col("kind") == "int", F.col("beta"))).alias("betas"),
        )
        .where(F.size("betas") > 0)
        .groupBy("depth", "list")
        .agg(F.array_distinct(F.flatten(F.collect_list("betas"))).alias("betas"))
    )
    per_box = lists.select("depth", F.explode("list").alias("box"), "betas").select(
        "depth",
        "box",
        F.array_contains("betas", F.col("box")).cast("bigint").alias("random"),
        F.size("betas").cast("bigint").alias("sets"),
    )
    return per_box.groupBy("depth", "box").agg(
        F.sum("random").alias("n_random_sets"),
        F.sum(F.col("sets") - F.col("random")).alias("n_zero_sets"),
    ).withColumn("n_conflicts", F.col("n_random_sets") * F.col("n_zero_sets"))


def box_columns(members: DataFrame, dof_col: int) -> DataFrame:
    """Column count and column index sum of each box from its members ``(depth, code, id)``."""
    # Sums of large ids leave the range of a long.
    cols = F.sum((F.col("id") * (dof_col * dof_col) + F.lit(dof_col * (dof_col - 1) // 2)).cast("decimal(28,0)"))
    return members.groupBy("depth", "code").agg(
        (F.count(F.lit(1)) * dof_col).alias("n_cols"), cols.alias("col_sum")
    )


def members(points: DataFrame, grid: Grid, depth: int, from_depth: int = 0) -> DataFrame:
    """Box code of every point at each depth from ``from_depth`` to ``depth``."""
    levels = points.select("id", *grid.cells(depth)).withColumn(
        "depth", F.explode(F.sequence(F.lit(from_depth), F.lit(depth)))
    )
    up = grid.coarsen(F.lit(depth) - F.col("depth"))
    return levels.select("id", "depth", *up).select("id", "depth", grid.code(F.col("depth")).alias("code"))
