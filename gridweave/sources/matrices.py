"""Matrix tables ``(i, j, v)`` from stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.sources.points import read


def matrix_from_table(df: DataFrame, i: Column | str, j: Column | str, v: Column | str) -> DataFrame:
    """Sum rows of a table into matrix entries; equal positions combine before the shuffle."""
    i, j, v = (F.col(c) if isinstance(c, str) else c for c in (i, j, v))
    return df.groupBy(i.cast("bigint").alias("i"), j.cast("bigint").alias("j")).agg(F.sum(v.cast("double")).alias("v"))


def matrix_from_arrays(df: DataFrame, i: str, values: str) -> DataFrame:
    """One matrix row per table row; the position in the array is the column."""
    return df.select(F.col(i).cast("bigint").alias("i"), F.posexplode(values).alias("j", "v")).select(
        "i", F.col("j").cast("bigint").alias("j"), F.col("v").cast("double").alias("v")
    )


def supply_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Supplier by part, quantity traded."""
    return matrix_from_table(read(spark, folder, "lineitem"), "l_suppkey", "l_partkey", "l_quantity")


def embedding_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Vector by position."""
    return matrix_from_arrays(read(spark, folder, "embeddings"), "vec_id", "embedding")


def trade_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Interaction of the patches of ``trade_points``: quantity and revenue share per traded pair.

    Every patch owns two rows and one column.  A traded line adds to the rows of its part at
    the supplier's column, and to the rows of its supplier at the part's column.
    """
    lines = read(spark, folder, "lineitem")
    part, supp = F.col("l_partkey") * 2, F.col("l_suppkey") * 2 + 1
    both = F.array(
        F.struct(part.alias("t"), supp.alias("j")),
        F.struct(supp.alias("t"), part.alias("j")),
    )
    pairs = (
        lines.groupBy("l_partkey", "l_suppkey")
        .agg(F.sum("l_quantity").alias("q"), F.sum(F.col("l_quantity") * F.col("l_linenumber")).alias("s"))
        .select("q", "s", F.inline(both))
    )
    comps = F.array(
        F.struct((F.col("t") * 2).alias("i"), F.col("q").alias("v")),
        F.struct((F.col("t") * 2 + 1).alias("i"), F.col("s").alias("v")),
    )
    return pairs.select("j", F.inline(comps)).select("i", "j", "v")


def nation_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Interaction of the patches of ``nation_points``: trade of each part with each supplier nation.

    A part's two rows hold quantity and weighted quantity at the nation's column; a nation's
    first row holds quantity at the part's column.  A box has few nations, so every
    well-separated block has a low rank by construction.  Lines are combined per part and
    supplier before they meet the suppliers.
    """
    lines = read(spark, folder, "lineitem").groupBy("l_partkey", "l_suppkey").agg(
        F.sum("l_quantity").alias("q"), F.sum(F.col("l_quantity") * F.col("l_linenumber")).alias("s")
    )
    home = read(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("bigint").alias("n")
    )
    pairs = (
        lines.join(home, "l_suppkey")
        .groupBy((F.col("l_partkey") * 2).alias("p"), (F.col("n") * 2 + 1).alias("n"))
        .agg(F.sum("q").alias("q"), F.sum("s").alias("s"))
    )
    entries = F.array(
        F.struct((F.col("p") * 2).alias("i"), F.col("n").alias("j"), F.col("q").alias("v")),
        F.struct((F.col("p") * 2 + 1).alias("i"), F.col("n").alias("j"), F.col("s").alias("v")),
        F.struct((F.col("n") * 2).alias("i"), F.col("p").alias("j"), F.col("q").alias("v")),
    )
    return pairs.select(F.inline(entries))
