"""Point tables ``(id, x, y[, z], len)`` from stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

XY = ("x", "y")
XYZ = ("x", "y", "z")


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def epoch_seconds(df: DataFrame, name: str) -> Column:
    """Seconds since 1970 with microseconds, independent of the session time zone for zone-free timestamps."""
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)")
    else:
        micros = F.unix_micros(name)
    return micros.cast("double") / F.lit(1e6)


def part_points(spark: SparkSession, folder: str) -> DataFrame:
    """2D points: size against retail price."""
    return read(spark, folder, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_size").cast("double").alias("x"),
        F.col("p_retailprice").cast("double").alias("y"),
        F.lit(0.1).alias("len"),
    )


def event_points(spark: SparkSession, folder: str) -> DataFrame:
    """3D points: time, value, user."""
    ev = read(spark, folder, "events")
    return ev.select(
        F.col("event_id").alias("id"),
        epoch_seconds(ev, "ts").alias("x"),
        F.col("value").cast("double").alias("y"),
        F.col("user_id").cast("double").alias("z"),
        F.lit(0.1).alias("len"),
    )


def _unit_parts(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "part").select(
        (F.col("p_partkey") * 2).alias("id"),
        (F.col("p_size").cast("double") / 50.0).alias("x"),
        ((F.col("p_retailprice") - 900.0) / 100.0).alias("y"),
        F.lit(0.1).alias("len"),
    )


def trade_points(spark: SparkSession, folder: str) -> DataFrame:
    """2D points of both trading sides on one unit-square domain.

    Parts get even ids, suppliers odd ones, so one point table carries both kinds of patches.
    """
    suppliers = read(spark, folder, "supplier").select(
        (F.col("s_suppkey") * 2 + 1).alias("id"),
        (F.col("s_nationkey").cast("double") / 25.0).alias("x"),
        (F.col("s_acctbal") / 10000.0).alias("y"),
        F.lit(0.1).alias("len"),
    )
    return _unit_parts(spark, folder).unionByName(suppliers)


def nation_points(spark: SparkSession, folder: str) -> DataFrame:
    """2D points of parts and nations on one unit-square domain, nations on a 5 by 5 lattice.

    Parts get even ids, nations odd ones.
    """
    nations = read(spark, folder, "nation").select(
        (F.col("n_nationkey").cast("bigint") * 2 + 1).alias("id"),
        ((F.col("n_nationkey") % 5).cast("double") / 5.0 + 0.1).alias("x"),
        (F.floor(F.col("n_nationkey") / 5).cast("double") / 5.0 + 0.1).alias("y"),
        F.lit(0.1).alias("len"),
    )
    return _unit_parts(spark, folder).unionByName(nations)


def unit_scaled(points: DataFrame, axes: Sequence[str] = XY) -> DataFrame:
    """Scale every axis to [0, 1] so that cells are near-cubic; a zero-span axis becomes 0."""
    row = points.agg(*[f(ax).alias(f"{ax}_{n}") for ax in axes for n, f in (("lo", F.min), ("hi", F.max))]).first()
    cols = []
    for ax in axes:
        lo, hi = row[f"{ax}_lo"], row[f"{ax}_hi"]
        cols.append((F.lit(0.0) if hi == lo else (F.col(ax) - F.lit(lo)) / F.lit(hi - lo)).alias(ax))
    return points.select(*[c for c in points.columns if c not in axes], *cols)


def validate(points: DataFrame, axes: Sequence[str] = XY) -> DataFrame:
    """Report of unusable rows: one row per reason with its count, zeros included.

    A duplicate id counts every row beyond the first.
    """
    if len(axes) not in (2, 3):
        raise ValueError(f"points must have 2 or 3 axes, got {len(axes)}")
    missing = [c for c in ("id", *axes) if c not in points.columns]
    if missing:
        raise ValueError(f"point table lacks columns {missing}")

    def any_of(test) -> Column:
        out = F.lit(False)
        for ax in axes:
            out = out | F.coalesce(test(F.col(ax).cast("double")), F.lit(False))
        return out

    inf = float("inf")
    flags = {
        "null_id": F.col("id").isNull(),
        "null_coordinate": any_of(lambda c: c.isNull()),
        "nan_coordinate": any_of(F.isnan),
        "infinite_coordinate": any_of(lambda c: c.isin(inf, -inf)),
        "bad_len": F.coalesce(F.isnan("len") | (F.col("len") < 0), F.col("len").isNull()),
    }
    per_id = points.groupBy("id").agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.sum(f.cast("bigint")).alias(name) for name, f in flags.items()],
    )
    dup = F.sum(F.when(F.col("id").isNull(), 0).otherwise(F.col("rows") - 1))
    total = per_id.agg(
        F.coalesce(dup, F.lit(0)).cast("bigint").alias("duplicate_id"),
        *[F.coalesce(F.sum(name), F.lit(0)).cast("bigint").alias(name) for name in flags],
    )
    return total.unpivot([], ["duplicate_id", *flags], "reason", "n_rows")
