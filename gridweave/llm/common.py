"""Reading, per-row Arrow work and bounded samples that the text operators share.

Operators take only the columns they name, under names of their own, so further columns
of the input may be called anything.  A null text counts as an empty one.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

Columns = dict[str, list]


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` of every row; null texts become empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def worker_store(name: str) -> dict:
    """A dictionary that a Python worker keeps from one task to the next; only for values that can be made again.

    A worker keeps the last name's alone, so the stores of different operators do not add up.
    """
    holder = sys.modules.setdefault("gridweave_worker_store", types.ModuleType("gridweave_worker_store"))
    if holder.__dict__.get("kept_for") != name:
        holder.__dict__.update(kept_for=name, store={})
    return holder.__dict__["store"]


def map_columns(df: DataFrame, make: Callable[[], Callable[[Columns], Iterator[Columns]]], schema: str) -> DataFrame:
    """Rows made per Arrow batch: ``make()`` is called once per task, its result once per batch and, with None, at the end."""
    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            given = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            for out in work(given):
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
        for out in work(None):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kind)


def per_row(fn: Callable[[Columns], Columns]) -> Callable[[], Callable[[Columns], Iterator[Columns]]]:
    """``make`` for work that needs nothing beyond one batch."""

    def make():
        def work(given: Columns | None) -> Iterator[Columns]:
            if given is not None:
                yield fn(given)

        return work

    return make


def labelled_sample(docs: DataFrame, labels: DataFrame, label_cols: list[str], max_rows: int, id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """At most ``max_rows`` labelled documents, those whose hashed id is smallest, so the choice is the same on every run.

    Rows with a null id or label have no part in it; of repeated labels of one id the smallest counts.
    """
    picked = (
        labels.select(F.col(id_col).cast("long").alias("_id"), *[F.col(c).cast("int").alias(f"_{c}") for c in label_cols])
        .dropna()
        .groupBy("_id")
        .agg(*[F.min(f"_{c}").alias(f"_{c}") for c in label_cols])
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_rows)
    )
    # Bounded by max_rows narrow rows.
    return docs.select(*[F.col(c) for c in (keep or docs.columns)]).join(F.broadcast(picked), F.col(id_col) == F.col("_id")).drop("_id")
