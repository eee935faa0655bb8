"""Stored layouts of a matrix that is multiplied many times.

Two bucketed copies, one by column and one by row: a product joins the vector to the copy whose
buckets follow the vector's key, so the matrix is never shuffled again.  What travels in a
step is the vector and the partial sums of the result.  Rows of a hot key are spread over salts
when the copies are written; the vector's entries of such keys are copied to their salts.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.durable import checkpoint_folder
from gridweave.skew import BROADCAST_KEYS, hot_table

# Rows of one bucket.
BUCKET_ROWS = 2_000_000


@dataclass(frozen=True)
class StoredMatrix:
    """Copies ``by_j`` and ``by_i`` of ``(i, j, v)``, each bucketed by its key, and by a salt ``_s`` too where there are hot keys."""

    by_j: DataFrame
    by_i: DataFrame
    hot_j: DataFrame | None
    hot_i: DataFrame | None
    names: tuple[str, str]

    @classmethod
    def write(cls, matrix: DataFrame, rows: int | None = None) -> StoredMatrix:
        """Write both copies of a written matrix; ``rows`` is its row count where known.

        A copy has at least as many buckets as shuffles have partitions, as Spark shuffles the
        bucketed side too where it has fewer.
        """
        spark = matrix.sparkSession
        rows = matrix.count() if rows is None else rows
        buckets = max(math.ceil(rows / BUCKET_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))
        stem = f"gridweave_{uuid.uuid4().hex}"
        made = {}
        for key, other in (("j", "i"), ("i", "j")):
            hot = hot_table(matrix, [key])
            salted, keys = matrix.select("i", "j", "v"), [key]
            if hot is not None:
                few = F.broadcast(hot) if hot.count() <= BROADCAST_KEYS else hot
                salts = F.coalesce(F.col("_salts"), F.lit(1).cast("bigint"))
                salted, keys = salted.join(few, key, "left").withColumn("_s", F.pmod(F.xxhash64(other), salts)).drop("_salts"), [key, "_s"]
            name = f"{stem}_{key}"
            (
                salted.repartition(buckets, *keys)
                .write.bucketBy(buckets, *keys).sortBy(*keys)
                .option("path", f"{checkpoint_folder(spark)}/{name}")
                .saveAsTable(name)
            )
            made[key] = spark.table(name), hot, name
        return cls(made["j"][0], made["i"][0], made["j"][1], made["i"][1], (made["j"][2], made["i"][2]))

    def forget(self) -> None:
        """Take both copies out of the session's catalog; their files stay in the checkpoint folder like other written tables."""
        for name in self.names:
            self.by_j.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")

    def matvec(self, vec: DataFrame) -> DataFrame:
        """``A x`` for ``(j, x)`` as ``(i, y)``."""
        return _product(self.by_j, vec, "j", "i", self.hot_j)

    def rmatvec(self, vec: DataFrame) -> DataFrame:
        """``A^T x`` for ``(i, x)`` as ``(j, y)``."""
        return _product(self.by_i, vec, "i", "j", self.hot_i)


def _product(copy: DataFrame, vec: DataFrame, key: str, out: str, hot: DataFrame | None) -> DataFrame:
    if hot is None:
        met = copy.join(vec.select(key, "x"), key)
    else:
        few = F.broadcast(hot) if hot.count() <= BROADCAST_KEYS else hot
        salts = F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("_salts"), F.lit(1).cast("bigint")) - 1)
        met = copy.join(vec.join(few, key, "left").select(key, "x", F.explode(salts).alias("_s")), [key, "_s"])
    return met.groupBy(out).agg(F.sum(F.col("v") * F.col("x")).alias("y"))
