"""Joining a large table to a table of unique keys when a few keys are hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.durable import cut_lineage

# Rows of one key that one task should handle at most.
HOT_ROWS = 500_000
# Hot keys up to this counted number are broadcast; more are joined, and adaptive execution splits that join.
BROADCAST_KEYS = 100_000


def hot_keys(big: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every key of more than ``hot_rows`` rows with the number of salts it needs.

    The count is combined map-side, so a key with a third of all rows costs no more than any other.
    """
    return (
        big.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > hot_rows)
        .select(*keys, F.ceil(F.col("_rows") / F.lit(hot_rows)).cast("bigint").alias("_salts"))
    )


def hot_table(table: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """``hot_keys`` of a stored table, written once; None where it is too small to have any.

    The row count of a stored table comes from its footers.
    """
    if table.count() <= hot_rows:
        return None
    return cut_lineage(hot_keys(table, keys, hot_rows))


def shuffled(side: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast.

    Without a shuffle below, Spark guesses a side's size from the bytes of its files, which say little where rows
    compress well or are expanded on the way; a side that follows the input then passes through the driver.
    """
    return side.hint("merge")


def skew_join(
    big: DataFrame, small: DataFrame, keys: Sequence[str], spread: Sequence[str], hot: DataFrame | None, follows_input: bool = False
) -> DataFrame:
    """Inner equi-join where rows of a hot key in ``big`` are spread over salts.

    ``hot`` comes from ``hot_table``.  ``spread`` names columns of ``big`` that tell its rows
    of one key apart.  Only the hot keys of ``small`` are copied, so the result holds exactly
    the plain join's rows.  Without ``hot`` it is the plain join, which adaptive execution
    may still split.  ``follows_input`` says that ``small`` has a row per point or more, so that it is shuffled.
    """
    keys = list(keys)
    held = shuffled if follows_input else lambda side: side
    if hot is None:
        return big.join(held(small), keys)
    return with_salt(big, keys, spread, hot).join(held(salt_copies(small, keys, hot)), [*keys, "_salt"]).drop("_salt")


def _met(side: DataFrame, keys: Sequence[str], hot: DataFrame) -> DataFrame:
    few = F.broadcast(hot) if hot.count() <= BROADCAST_KEYS else hot
    return side.join(few, list(keys), "left").withColumn("_salts", F.coalesce(F.col("_salts"), F.lit(1).cast("bigint")))


def with_salt(big: DataFrame, keys: Sequence[str], spread: Sequence[str], hot: DataFrame | None) -> DataFrame:
    """``big`` with a column ``_salt``: rows of a hot key are dealt over its salts by the columns ``spread``."""
    if hot is None:
        return big.withColumn("_salt", F.lit(0).cast("bigint"))
    return _met(big, keys, hot).withColumn("_salt", F.pmod(F.xxhash64(*spread), F.col("_salts"))).drop("_salts")


def salt_copies(small: DataFrame, keys: Sequence[str], hot: DataFrame | None) -> DataFrame:
    """``small`` with a column ``_salt``: one row per salt of its key."""
    if hot is None:
        return small.withColumn("_salt", F.lit(0).cast("bigint"))
    every = F.sequence(F.lit(0).cast("bigint"), F.col("_salts") - 1)
    return _met(small, keys, hot).withColumn("_salt", F.explode(every)).drop("_salts")
