"""A training corpus from raw documents: quality, near duplicates, benchmark passages, secrets, packed windows.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; ``run`` writes
each result as Parquet to the shared folder and reads it again.  Null texts count as empty, tables
without rows stay so, and columns beyond those named here pass through all stages but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.durable import checkpoint_folder, cut_lineage
from gridweave.llm import decontaminate, neardup, packing, quality, secret_spans
from gridweave.llm.common import read

# No SQL: models, alignment and tokenization have none.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier passes; texts without a word go."""
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return docs.where(quality.passes(model))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group.  Rows without an id stay.

    Of repeated ids one row stays: the one with the smallest hash of its text, then the smallest text, then the
    smallest of its columns written as JSON.
    """
    found = cut_lineage(neardup.near_duplicates(docs).where(F.col("doc_id").isNotNull()))
    ids = found.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    gone = ids.where(~F.col("kept")).select(F.col("doc_id").alias("_gone"))
    kept = docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
    if ids.where("kept and n > 1").limit(1).count() == 0:
        return kept
    text = F.coalesce(F.col("text"), F.lit(""))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    order = F.struct(F.xxhash64(text), text, F.to_json(whole))
    # Repeats of an id are few but for errors of the source; their smallest is found by map-side combining.
    one = kept.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min_by(whole, order).alias("_doc"))
    return kept.where("doc_id IS NULL").unionByName(one.select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns]))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontaminate.clean(docs, decontaminate.matchers(docs, read(spark, sf_dir, "benchmark")))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and ``n_chars`` of the new text."""
    masked = secret_spans.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed windows, with their ids."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secret_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
