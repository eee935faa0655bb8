"""Cutting lineage with tables in the cluster's shared checkpoint folder.

A written table survives the loss of executors, is computed once, and carries its
true size, so later joins choose their strategy from facts.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def checkpoint_folder(spark: SparkSession) -> str:
    """Folder named by the session; a temporary one only where the session names none."""
    named = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY, None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_KEY} to a folder all executors can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gridweave-"))
    return spark.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder and read it back."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/gridweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
