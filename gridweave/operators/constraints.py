"""Sampling constraints of any pair of boxes of one depth, and the graph of their conflicts.

A constraint asks for random columns in one box and zero columns in the boxes around a
target: those that touch it and those well separated from it.  A target's list has at most
``6^d`` boxes by the grid, so lists are short arrays and never grow with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.grid import Grid
from gridweave.operators.boxes import rollup

# How a request's random box lies to its target.
PLACES = ("own", "nei", "int", "out", "no_box", "depths_differ")


def box_lists(pairs: DataFrame, grid: Grid) -> DataFrame:
    """``(depth, alpha, nei, int)``: sorted codes of the boxes that touch a box, itself included, and of those well separated."""
    depth = F.col("depth")
    coded = pairs.select("depth", grid.code(depth, "a_").alias("alpha"), grid.code(depth, "b_").alias("beta"), "kind")
    # collect_list leaves out nulls.
    return coded.groupBy("depth", "alpha").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("beta")))).alias(k) for k in ("nei", "int")]
    )


def constraint_sets(requests: DataFrame, box: DataFrame, pairs: DataFrame, grid: Grid) -> DataFrame:
    """Zero boxes for each request ``(depth, alpha, beta_depth, beta)``: adds ``place`` and ``zero_boxes``.

    ``beta`` is the random box.  It may be ``alpha`` itself (``own``), touch it (``nei``), be well
    separated (``int``) or lie in neither list (``out``); the zero boxes are the union of both
    lists without it.  A request across depths (``depths_differ``) or for a box that is empty
    (``no_box``) gets no list, as does one with a null.
    """
    depth = F.col("depth")
    known = box.select(F.col("depth").alias("beta_depth"), grid.code(depth).alias("beta"), F.lit(True).alias("_held"))
    met = requests.join(box_lists(pairs, grid), ["depth", "alpha"], "left").join(known, ["beta_depth", "beta"], "left")
    place = (
        F.when(F.col("nei").isNull() | F.col("_held").isNull(), "no_box")
        .when(F.col("depth") != F.col("beta_depth"), "depths_differ")
        .when(F.col("alpha") == F.col("beta"), "own")
        .when(F.array_contains("nei", F.col("beta")), "nei")
        .when(F.array_contains("int", F.col("beta")), "int")
        .otherwise("out")
    )
    union = F.array_except(F.array_sort(F.concat("nei", "int")), F.array("beta"))
    served = ~F.col("place").isin("no_box", "depths_differ")
    return (
        met.withColumn("place", place)
        .withColumn("zero_boxes", F.when(served, union))
        .select("depth", "alpha", "beta_depth", "beta", "place", "zero_boxes")
    )


def box_column_sums(points: DataFrame, grid: Grid, depth: int) -> DataFrame:
    """``(depth, code, n_cols, col_sum)``: number and sum of the matrix columns of every box.

    Counted per finest cell first; only cells climb the depths.
    """
    dof = grid.dof_col
    # Sums of large ids leave the range of a long.
    own = F.sum((F.col("id") * (dof * dof) + F.lit(dof * (dof - 1) // 2)).cast("decimal(28,0)"))
    cells = rollup(
        points.select("id", *grid.axes), grid, depth,
        [F.count(F.lit(1)).alias("n"), own.alias("s")],
        [F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s")],
    )
    return cells.select("depth", grid.code(F.col("depth")).alias("code"), (F.col("n") * dof).alias("n_cols"), F.col("s").alias("col_sum"))


def constraint_set_columns(requests: DataFrame, box: DataFrame, pairs: DataFrame, box_cols: DataFrame, grid: Grid) -> DataFrame:
    """Random and zero columns of each request: ``n_random, random_sum, n_zero, zero_sum``, null where it gets no list.

    A target's list is added up once; where the random box is in it, its columns are taken off again.
    """
    depth = F.col("depth")
    coded = pairs.select("depth", grid.code(depth, "a_").alias("alpha"), grid.code(depth, "b_").alias("code"))
    totals = coded.join(box_cols, ["depth", "code"]).groupBy("depth", "alpha").agg(
        F.sum("n_cols").alias("all_cols"), F.sum("col_sum").cast("decimal(38,0)").alias("all_sum")
    )
    random = box_cols.select(F.col("depth").alias("beta_depth"), F.col("code").alias("beta"), F.col("n_cols").alias("n_random"), F.col("col_sum").alias("random_sum"))
    sets = constraint_sets(requests, box, pairs, grid).drop("zero_boxes")
    met = sets.join(totals, ["depth", "alpha"], "left").join(random, ["beta_depth", "beta"], "left")
    served = ~F.col("place").isin("no_box", "depths_differ")
    inside = F.col("place") != "out"

    def less(total: str, part: str):
        return F.when(served, F.col(total) - F.when(inside, F.col(part)).otherwise(F.lit(0)))

    return met.select(
        "depth", "alpha", "beta_depth", "beta", "place",
        F.when(served, F.col("n_random")).alias("n_random"),
        F.when(served, F.col("random_sum")).alias("random_sum"),
        less("all_cols", "n_random").alias("n_zero"),
        less("all_sum", "random_sum").cast("decimal(38,0)").alias("zero_sum"),
    )


def distinct_sets(pairs: DataFrame, grid: Grid) -> DataFrame:
    """Distinct constraint sets: ``(depth, beta, list_of, list, n_blocks)``.

    Targets with equal lists ask for the same sets; ``list_of`` is the smallest of them and names
    the list, ``n_blocks`` are the interaction blocks that share the set.
    """
    lists = box_lists(pairs, grid).where(F.size("int") > 0).select("depth", "alpha", F.array_sort(F.concat("nei", "int")).alias("list"), "int")
    # Targets of one list lie within it, so at most 6^d share it.
    shared = lists.groupBy("depth", "list").agg(F.min("alpha").alias("list_of"), F.flatten(F.collect_list("int")).alias("betas"))
    return shared.select("depth", "list_of", "list", F.explode("betas").alias("beta")).groupBy("depth", "beta", "list_of").agg(
        F.first("list").alias("list"), F.count(F.lit(1)).alias("n_blocks")
    )


def conflict_edges(sets: DataFrame) -> DataFrame:
    """Edges between sets of one depth of which one needs a box random that the other needs zero.

    ``sets`` comes from ``distinct_sets`` and should be written.  Each edge comes once, as
    ``(depth, a_beta, a_list, b_beta, b_list)`` with the smaller end first.  The join is on (depth, box);
    an edge that both ends give is kept from the smaller one, which its own list tells, so
    edges are never shuffled to find copies.
    """
    random = sets.select("depth", F.col("beta").alias("box"), F.col("list_of").alias("x_list"), F.col("list").alias("x_boxes"))
    zero = (
        sets.select("depth", F.col("beta").alias("y_beta"), F.col("list_of").alias("y_list"), F.explode("list").alias("box"))
        .where(F.col("box") != F.col("y_beta"))
    )
    met = random.join(zero, ["depth", "box"])
    first = F.struct(F.col("box").alias("b"), F.col("x_list").alias("l"))
    second = F.struct(F.col("y_beta").alias("b"), F.col("y_list").alias("l"))
    # The other end meets this one too where its random box is zero here.
    mutual = F.array_contains("x_boxes", F.col("y_beta")) & (F.col("box") != F.col("y_beta"))
    return (
        met.where(~mutual | (first < second))
        .select("depth", F.least(first, second).alias("a"), F.greatest(first, second).alias("z"))
        .select("depth", F.col("a.b").alias("a_beta"), F.col("a.l").alias("a_list"), F.col("z.b").alias("b_beta"), F.col("z.l").alias("b_list"))
    )


def conflict_graph(sets: DataFrame, edges: DataFrame) -> DataFrame:
    """Each distinct set with the blocks that share it and the sets it conflicts with: ``(depth, beta, list_of, n_blocks, degree)``."""
    ends = F.array(F.struct(F.col("a_beta").alias("beta"), F.col("a_list").alias("list_of")), F.struct(F.col("b_beta").alias("beta"), F.col("b_list").alias("list_of")))
    degree = edges.select("depth", F.inline(ends)).groupBy("depth", "beta", "list_of").agg(F.count(F.lit(1)).alias("degree"))
    key = ["depth", "beta", "list_of"]
    return sets.select(*key, "n_blocks").join(degree, key, "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("bigint")))
