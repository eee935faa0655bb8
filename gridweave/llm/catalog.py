"""Queries over the stored tables, one per operator, each on its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm import (
    automaton, counting, decontaminate, divergence, html_text, katz, neardup, packing, quality, rules, secret_spans, toxicity, whitening,
)
from gridweave.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of every document, and again after edits drawn from its id."""
    trees = counting.count_trees(read(spark, sf, "documents"))
    after = counting.recount(counting.drawn_edits(trees))
    return after.select("doc_id", F.col("n_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), "n_reencoded", F.size("leaf_tokens").alias("n_leaves"))


def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Grades: 0 not toxic, 1 toxic, 2 toxic and of low quality."""
    docs = read(spark, sf, "documents")
    graded = read(spark, sf, "labels").select("doc_id", (F.col("toxic") * (2 - F.col("quality"))).alias("grade"))
    return toxicity.score(docs, toxicity.train(docs, graded))


def op3_katz_backoff(spark: SparkSession, sf: str) -> DataFrame:
    return katz.score(read(spark, sf, "documents"))


def op4_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces with a digest of their ids in place of the ids."""
    return packing.pack(read(spark, sf, "documents")).drop("ids")


def op5_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    return decontaminate.matches(docs, decontaminate.matchers(docs, read(spark, sf, "benchmark")))


def op6_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf, "documents"))


def op7_line_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return rules.judge(read(spark, sf, "documents"))


def op8_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.extract(read(spark, sf, "pages"))


def op9_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    return quality.score(docs, quality.train(docs, read(spark, sf, "labels")))


def op10_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secret_spans.scan(read(spark, sf, "documents"))


def op11_whitening(spark: SparkSession, sf: str) -> DataFrame:
    """A deviation beyond a long, which takes millions of vectors, is null here; the operator has it as a decimal."""
    out = whitening.whiten(read(spark, sf, "embeddings"))
    return out.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op12_source_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return divergence.audit(read(spark, sf, "documents"))


def op13_bpe_automaton(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of the ids and of the text that they give again."""
    out = automaton.round_trip(read(spark, sf, "documents"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def queries() -> dict[str, Query]:
    found = [
        op1_token_counts, op2_toxicity, op3_katz_backoff, op4_packing, op5_decontamination, op6_near_duplicates, op7_line_frequency,
        op8_html_extraction, op9_quality, op10_secrets, op11_whitening, op12_source_divergence, op13_bpe_automaton,
    ]
    return {f.__name__: f for f in found}


# Counts, the base rule and the verdict on shared lines, with lines compared as normalised text.
OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents
),
w AS (
  SELECT rid, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d
),
win AS (
  SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3
),
keyed AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM win),
again AS (SELECT rid, i FROM keyed QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
rep AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY rid
),
ln AS (SELECT rid, source, text, unnest(string_split(text, chr(10))) AS line FROM d),
own AS (
  SELECT *, trim(regexp_replace(lower(line), '[\s[:punct:]\d]+', ' ', 'g')) AS norm FROM ln
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n, sum(length(line)) AS chars FROM own GROUP BY rid),
host AS (SELECT source, count(DISTINCT text) AS n FROM d GROUP BY source),
often AS (
  SELECT source, norm, count(DISTINCT text) AS n FROM own GROUP BY source, norm
),
bad AS (
  SELECT o.source, o.norm FROM often o JOIN host h ON o.source IS NOT DISTINCT FROM h.source
  WHERE o.n > greatest(20, h.n * 0.05::DOUBLE)
),
gone AS (
  SELECT own.rid, sum(length(own.line)) AS chars FROM own
  JOIN bad ON own.source IS NOT DISTINCT FROM bad.source AND own.norm = bad.norm GROUP BY own.rid
),
f AS (
  SELECT d.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(d.text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(dup.chars, 0) AS BIGINT) AS line_chars,
    CAST(coalesce(gone.chars, 0) AS BIGINT) AS removed_chars
  FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN gone USING (rid)
)
SELECT *, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed,
  NOT (n_words < 50 OR n_repeat_words * 100 > n_words * 50) AND removed_chars <= line_chars * 0.5::DOUBLE AS kept
FROM f
"""

# Distinct shingles per document, links by their shared count, components by the smallest reachable id.
OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
),
s AS (
  SELECT DISTINCT doc_id, hash(g) AS g FROM (
    SELECT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 3, 2)), lambda i: array_to_string(ws[i:i + 4], ' '))) AS g
    FROM w WHERE len(ws) > 0
  )
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
),
l AS (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)
),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (
  SELECT doc_id, doc_id FROM documents WHERE doc_id IS NOT NULL
  UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id AND r.root < e.b
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.root AS component_id, d.doc_id = m.root AS kept
FROM documents d LEFT JOIN n USING (doc_id)
LEFT JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id) m USING (doc_id)
"""


# Every kept term of every group, counted or not, without cells.
OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
),
t AS (
  SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT rid) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
l AS (SELECT lang, CAST(sum(n) AS HUGEINT) AS n, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS n FROM c GROUP BY ALL),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (coalesce(s.n, 0) + l.v) AS p,
    1 + 1000000000::HUGEINT * (k.n + 1) // (l.n + l.v) AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN c USING (lang, source, term)
),
f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
),
term AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM dense WHERE n > 0 AND p > q
)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pair UNION ALL SELECT * FROM term) QUALIFY part = 'pair' OR rank <= 200
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_near_duplicates": OP6_SQL, "op7_line_frequency": OP7_SQL, "op12_source_divergence": OP12_SQL}
