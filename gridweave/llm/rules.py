"""Quality rules on DataFrame functions only: word and repetition counts, and lines that many documents of a host share.

A line counts once per distinct text of a host, or once per document.  Lines above the limit are boilerplate; a
document that consists of them for the most part is depleted and rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.durable import cut_lineage

MIN_DOCS = 20
HOST_SHARE = 0.05
DEPLETED = 0.5
_SALTS = 16

# White space and symbols of the base counts.
_SPACE = " \t\n\x0b\f\r"
_SPLIT = "[\\x20\\x09-\\x0D]+"
_SYMBOLS = "#*$%&|<>"


def _shifted(array: str, by: int) -> Column:
    return F.slice(array, F.lit(1 + by), F.greatest(F.size(array) - by, F.lit(0)))


def normalised(line: Column) -> Column:
    """Lower case, with digits, punctuation and white space as single spaces."""
    return F.trim(F.regexp_replace(F.lower(line), "[\\s\\p{Punct}\\d]+", " "))


def _worded(line: Column) -> Column:
    return F.length(F.translate(line, _SPACE, "")) > 0


def _hashed(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.struct(F.xxhash64(normalised(x)).alias("h"), F.length(x).alias("n")))


def _repeated(df: DataFrame) -> DataFrame:
    """``n_repeat_words`` from ``_words``: words covered by 3-word windows that occur twice or more.

    Windows are compared by 64-bit hashes of their words.  Only texts with equal windows are sorted.
    """
    both = F.zip_with("_h1", _shifted("_h1", 1), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn("_h1", F.transform("_words", lambda w: F.xxhash64(w))).withColumn("_h2", both)
    df = df.withColumn("_win", F.slice(F.zip_with("_h2", _shifted("_h1", 2), lambda a, b: F.xxhash64(a, b)), F.lit(1), F.greatest(F.size("_h1") - 2, F.lit(0))))
    df = df.withColumn("_uneven", F.size(F.array_distinct("_win")) < F.size("_win")).drop("_h1", "_h2")
    placed = F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    none = F.expr("CAST(array() AS array<struct<h:bigint,i:int>>)")
    df = df.withColumn("_sorted", F.when(F.col("_uneven"), F.array_sort(placed)).otherwise(none)).drop("_win", "_uneven")
    equal = F.filter(
        F.zip_with("_sorted", _shifted("_sorted", 1), lambda a, b: F.struct((a["h"] == b["h"]).alias("e"), a["i"].alias("i"), b["i"].alias("j"))),
        lambda x: x["e"],
    )
    df = df.withColumn("_equal", equal).drop("_sorted")
    df = df.withColumn("_at", F.array_sort(F.array_distinct(F.concat(F.transform("_equal", lambda x: x["i"]), F.transform("_equal", lambda x: x["j"])))))
    # Windows start at _at in order; each adds what the one before has not covered.
    gaps = F.transform(F.zip_with("_at", _shifted("_at", 1), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3))), lambda x: x.cast("long"))
    return df.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0).cast("long"), lambda t, x: t + x)).drop("_equal", "_at")


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str | None = "source") -> DataFrame:
    """The counts per row, with ``_host``, ``_key`` (hash of the text) and ``_lines`` (hash and length of each line with a word)."""
    host = F.col(host_col).cast("string") if host_col else F.lit(None).cast("string")
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), host.alias("_host"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    size = F.length("_text")
    df = df.select(
        "doc_id",
        "_host",
        "_text",
        F.xxhash64("_text").alias("_key"),
        F.length(F.translate("_text", _SPACE, "")).cast("long").alias("word_chars"),
        (size - F.length(F.translate("_text", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("_text", _SPLIT), lambda w: w != "").alias("_words"),
        F.filter(F.split("_text", "\n"), _worded).alias("_own"),
    )
    df = df.select(
        "doc_id",
        "_host",
        "_key",
        F.size("_words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("_own") - F.size(F.array_distinct("_own"))).cast("long").alias("n_dup_lines"),
        "_words",
        _hashed(F.col("_own")).alias("_lines"),
    )
    return _repeated(df).drop("_words")


def _above(rows: DataFrame, min_docs: int, host_share: float, count_copies: bool, max_docs: int | None) -> DataFrame:
    """``_host2, _key2, _gone``: for each text of a host that has any, the hashes of its lines above the limit."""
    texts = rows.select("_host", "_key", F.array_distinct(F.transform("_lines", lambda x: x["h"])).alias("_hs")).dropDuplicates(["_host", "_key"])
    units = texts
    if count_copies:
        own = rows.select("_host", "doc_id", F.transform("_lines", lambda x: x["h"]).alias("_hs"))
        named = own.where("doc_id IS NOT NULL").groupBy("_host", "doc_id").agg(F.flatten(F.collect_list("_hs")).alias("_hs"))
        units = named.unionByName(own.where("doc_id IS NULL")).withColumn("_hs", F.array_distinct("_hs"))
    least = min_docs if max_docs is None else max_docs
    seen = units.select("_host", F.explode("_hs").alias("_h")).groupBy("_host", "_h").agg(F.count(F.lit(1)).alias("_docs")).where(F.col("_docs") > least)
    if max_docs is None:
        limit = units.groupBy("_host").agg(F.greatest(F.lit(float(min_docs)), F.count(F.lit(1)) * host_share).alias("_limit"))
        seen = seen.join(limit.withColumnRenamed("_host", "_host2"), F.col("_host").eqNullSafe(F.col("_host2"))).where(F.col("_docs") > F.col("_limit"))
    above = cut_lineage(seen.select("_host", "_h", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("_salt")))
    # A line may stand in a third of all texts, so its rows are spread over salts.
    host = F.coalesce(F.col("_host"), F.lit(""))
    group = F.xxhash64(host, F.col("_host").isNull(), "_h")
    return (
        texts.select("_host", "_key", F.explode("_hs").alias("_h"))
        .select("_host", "_key", "_h", group.alias("_g"), F.pmod("_key", F.lit(_SALTS)).cast("int").alias("_salt"))
        .join(above.select(group.alias("_g"), "_salt"), ["_g", "_salt"], "left_semi")
        .groupBy("_host", "_key")
        .agg(F.collect_list("_h").alias("_gone"))
        .select(F.col("_host").alias("_host2"), F.col("_key").alias("_key2"), "_gone")
    )


def _with_gone(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows`` with the hashes of their lines above the limit."""
    out = rows.join(gone, (F.col("_key") == F.col("_key2")) & F.col("_host").eqNullSafe(F.col("_host2")), "left")
    return out.withColumn("_gone", F.coalesce("_gone", F.expr("CAST(array() AS array<bigint>)"))).drop("_host2", "_key2")


def without_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str | None = "source", min_docs: int = MIN_DOCS, host_share: float = HOST_SHARE, count_copies: bool = False, max_docs: int | None = None) -> DataFrame:
    """``docs`` with the lines above the limit of ``judge`` taken out of the texts.

    The other lines stay as they are, in their order and with the empty ones between them.  Other columns, nulls
    and row counts stay.
    """
    host = F.col(host_col).cast("string") if host_col else F.lit(None).cast("string")
    text = F.coalesce(F.col(text_col), F.lit(""))
    # The caller's columns travel in one, whatever they are called.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    keyed = docs.select(whole, F.col(id_col).cast("long").alias("_id"), host.alias("_host"), F.xxhash64(text).alias("_key"), text.alias("_text"))
    rows = cut_lineage(keyed.select(F.col("_id").alias("doc_id"), "_host", "_key", _hashed(F.filter(F.split("_text", "\n"), _worded)).alias("_lines")))
    out = _with_gone(keyed, _above(rows, min_docs, host_share, count_copies, max_docs))
    left = F.filter(F.split("_text", "\n"), lambda x: ~(_worded(x) & F.array_contains(F.col("_gone"), F.xxhash64(normalised(x)))))
    own = F.col("_doc").getField(text_col)
    kept = F.when(F.size("_gone") == 0, own).otherwise(F.array_join(left, "\n"))
    return out.select(*[(kept if c == text_col else F.col("_doc").getField(c)).alias(c) for c in docs.columns])


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str | None = "source",
    min_docs: int = MIN_DOCS,
    host_share: float = HOST_SHARE,
    depleted: float = DEPLETED,
    count_copies: bool = False,
    max_docs: int | None = None,
) -> DataFrame:
    """One row per row of ``docs``: the counts, ``base_failed``, ``line_chars``, ``removed_chars`` and ``kept``.

    A line is above the limit if more than ``min_docs`` and more than ``host_share`` of the distinct
    texts of its host hold it.  With ``count_copies`` documents count instead of distinct texts, each id
    once and rows without an id each; with ``max_docs`` the limit is that number, whatever the size of the
    host.  ``kept`` is false if the base failed or more than ``depleted`` of the characters stand in such
    lines.  A null text has no words, so its base fails; null hosts are one host; null ids stay; repeated
    rows are judged alike; an empty table gives an empty one.
    """
    rows = cut_lineage(base_counts(docs, id_col, text_col, host_col))
    out = _with_gone(rows, _above(rows, min_docs, host_share, count_copies, max_docs))
    chars = lambda lines: F.aggregate(lines, F.lit(0).cast("long"), lambda t, x: t + x["n"])
    left = F.filter("_lines", lambda x: ~F.array_contains(F.col("_gone"), x["h"]))
    out = out.withColumn("line_chars", chars("_lines")).withColumn("removed_chars", F.when(F.size("_gone") == 0, F.lit(0).cast("long")).otherwise(F.col("line_chars") - chars(left)))
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return out.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "line_chars",
        "removed_chars",
        failed.alias("base_failed"),
        (~failed & (F.col("removed_chars") <= F.col("line_chars") * depleted)).alias("kept"),
    )
