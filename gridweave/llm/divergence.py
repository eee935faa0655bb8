"""How the vocabulary of each source differs from that of the other sources of its language.

A divergence depends on a term only through its two counts, so terms are grouped into cells by
(count here, count there) with a multiplicity, and the divergence is computed once per cell.
Sources are compared by sums over their cells; what terms give that one or both of two sources
lack follows from the cells of each source alone, so only terms that both hold are met.  The
leading terms of a source are found by running totals over its ranked cells; only cells that
reach the limit are expanded to terms again.  All numbers are whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.durable import cut_lineage
from gridweave.llm.common import Columns, map_columns

# Documents of a language that a kept term must be in.
LEAST_DOCS = 3
# Leading terms listed per source.
TOP_TERMS = 200
# Fixed value: the scale of the whole-number probabilities.
SCALE = 1_000_000_000
# Term counts that a task holds before it sends them on, and documents.
HELD_TERMS, HELD_DOCS = 500_000, 1 << 22

# Letters A-Z become small, other ASCII parts terms, bytes of longer UTF-8 characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

# A task's documents and occurrences of one term share a number: 2^23 documents, 2^40 occurrences.
_BITS = 40
_ONE_DOC = 1 << _BITS

_GROUP = ["lang", "source"]


def _named(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    def plain(name: str, out: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(out)

    return docs.select(plain(text_col, "text"), plain(lang_col, "lang"), plain(source_col, "source"))


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, term, n, n_docs``: partial counts per task, several rows a key; a row with a null term stands for a group alone."""

    def make():
        # One number per term: documents above the lower bits, occurrences in them.
        held: dict[tuple[str, str], dict[bytes, int]] = {}
        size = read = 0

        def flush() -> Columns:
            lang, source, term, packed = [], [], [], []
            for (own_lang, own_source), terms in held.items():
                rows = len(terms) + 1
                lang += [own_lang] * rows
                source += [own_source] * rows
                term.append(None)
                term += terms
                packed.append(0)
                packed += terms.values()
            held.clear()
            numbers = np.array(packed, np.int64)
            return {"lang": lang, "source": source, "term": term, "n": numbers & (_ONE_DOC - 1), "n_docs": numbers >> _BITS}

        def work(given: Columns | None) -> Iterator[Columns]:
            nonlocal size, read
            if given is None:
                yield flush()
                return
            for text, lang, source in zip(given["text"], given["lang"], given["source"], strict=True):
                terms = held.setdefault((lang, source), {})
                before, seen = len(terms), terms.get
                for term, n in Counter(text.encode().translate(_FOLD).split()).items():
                    terms[term] = seen(term, 0) + n + _ONE_DOC
                size += len(terms) - before
                read += 1
                if size >= HELD_TERMS or read >= HELD_DOCS:
                    yield flush()
                    size = read = 0

        return work

    return map_columns(_named(docs, text_col, lang_col, source_col), make, "lang string, source string, term string, n long, n_docs long")


def kept_terms(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """One row per kept term of a language: ``lang, term, n`` and ``held``, its (source, n) pairs, at most one per source.

    Both groupings share one shuffle, on (lang, term).
    """
    own = (
        counts.where("term IS NOT NULL")
        .repartition("lang", "term")
        .groupBy("lang", "term", "source")
        .agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    )
    return (
        own.groupBy("lang", "term")
        .agg(F.sum("n_docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("held"))
        .where(F.col("docs") >= least_docs)
        .drop("docs")
    )


def probability(count: str, total: str, terms: str) -> Column:
    """``1 + floor(SCALE (count + 1) / (total + terms))``, also where the product is beyond a long."""
    wide = f"cast({count} + 1 as decimal(28,0)) * cast({SCALE} as decimal(10,0))"
    small = f"{count} < {(1 << 62) // SCALE}"
    below = f"greatest({total} + {terms}, 1L)"  # a language without kept terms has no cell to weigh
    return F.expr(f"1 + if({small}, ({count} + 1) * {SCALE}L div {below}, cast(({wide}) div cast({below} as decimal(28,0)) as bigint))")


def divergence(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / q)``; probabilities are at most SCALE + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def _groups(counts: DataFrame, kept: DataFrame) -> DataFrame:
    """Every group with the occurrences of kept terms in it, and its language's totals: ``lang, source, total, lang_total, terms``."""
    per_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count(F.lit(1)).alias("terms"))
    held = kept.select("lang", F.inline("held")).groupBy(*_GROUP).agg(F.sum("n").alias("total"))
    every = counts.where("term IS NULL").select(*_GROUP).distinct()
    zero = F.lit(0).cast("bigint")
    return (
        every.join(held, _GROUP, "left")
        .join(per_lang, "lang", "left")
        .select(*_GROUP, *[F.coalesce(F.col(c), zero).alias(c) for c in ("total", "lang_total", "terms")])
    )


def met_cells(kept: DataFrame) -> DataFrame:
    """Cells of the terms that two sources of a language both hold: ``lang, source, item, own, other, m``, ``source`` before ``item``."""
    one = kept.select("lang", F.explode("held").alias("a"), "held").select("lang", "a", F.explode("held").alias("b")).where("a.source < b.source")
    return one.groupBy("lang", F.col("a.source").alias("source"), F.col("b.source").alias("item"), F.col("a.n").alias("own"), F.col("b.n").alias("other")).agg(
        F.count(F.lit(1)).alias("m")
    )


def source_divergence(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value``: for every other source of the language, the divergence summed over all kept terms.

    If no term were held by both, the terms of each would face the count 0, and all others two of
    them.  A met cell takes its terms out of these three and puts in their own divergence.
    """
    zero = F.lit(0).cast("bigint")
    size = groups.select("lang", "source", "total", "terms")
    other = groups.select("lang", F.col("source").alias("item"), F.col("total").alias("item_total"))
    mine = {c: probability(c, "total", "terms") for c in ("own", "other", "0L")}
    theirs = {c: probability(c, "item_total", "terms") for c in ("own", "other", "0L")}

    def times(value: Column, m: str) -> Column:
        return F.sum(value.cast("decimal(20,0)") * F.col(m).cast("decimal(18,0)"))

    def gain(p: Column, q: Column, p0: Column, q0: Column) -> Column:
        # Each divergence is below 2^61, so the four fit a long.
        return divergence(p, q) - divergence(p, q0) - divergence(p0, q) + divergence(p0, q0)

    met = met_cells(kept).join(size, _GROUP).join(other, ["lang", "item"]).withColumns(
        {"p": mine["own"], "q": theirs["other"], "p0": mine["0L"], "q0": theirs["0L"]}
    )
    p, q, p0, q0 = (F.col(c) for c in ("p", "q", "p0", "q0"))
    gains = met.groupBy("lang", "source", "item").agg(times(gain(p, q, p0, q0), "m").alias("there"), times(gain(q, p, q0, p0), "m").alias("back"))
    ways = F.array(
        F.struct("source", "item", F.col("there").alias("value")),
        F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")),
    )
    both = gains.select("lang", F.inline(ways))

    alone = kept.select("lang", F.inline("held")).groupBy("lang", "source", F.col("n").alias("own")).agg(F.count(F.lit(1)).alias("m"))
    held = alone.groupBy(*_GROUP).agg(F.sum("m").alias("held"))
    named = size.join(held, _GROUP, "left").withColumn("held", F.coalesce("held", zero))
    others = named.join(named.select("lang", F.col("source").alias("item"), F.col("total").alias("item_total"), F.col("held").alias("item_held")), "lang").where("source <> item")
    cells = others.join(alone, _GROUP)
    here = cells.groupBy("lang", "source", "item").agg(times(divergence(mine["own"], theirs["0L"]), "m").alias("value"))
    # The same cells seen from the other source: its terms face the count 0 here.
    away = cells.groupBy("lang", F.col("item").alias("source"), F.col("source").alias("item")).agg(
        times(divergence(theirs["0L"], mine["own"]), "m").alias("value")
    )
    neither = (F.col("terms") - F.col("held") - F.col("item_held")).cast("decimal(18,0)")
    rest = others.select("lang", "source", "item", (divergence(mine["0L"], theirs["0L"]).cast("decimal(20,0)") * neither).alias("value"))
    parts = both.unionByName(here).unionByName(away).unionByName(rest)
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").cast("bigint").alias("value"))


def term_divergence(kept: DataFrame, groups: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, item, value, rank``: the leading terms that a source has more often than its language, up to ``top``.

    Cells of equal value are merged and ranked by running totals of their terms; the terms of
    the cells that begin within ``top`` come back in UTF-8 order, ``top`` of each value at most.
    """
    cell = [*_GROUP, "own", "all"]
    rows = kept.select("lang", "term", F.col("n").alias("all"), F.inline("held")).withColumnRenamed("n", "own")
    p, q = probability("own", "total", "terms"), probability("all", "lang_total", "terms")
    valued = (
        rows.groupBy(*cell)
        .agg(F.count(F.lit(1)).alias("m"))
        .join(groups, _GROUP)
        .withColumns({"p": p, "q": q})
        .where("p > q")
        .select(*cell, "m", divergence(F.col("p"), F.col("q")).alias("value"))
    )
    classes = valued.groupBy(*_GROUP, "value").agg(F.sum("m").alias("m"))
    above = Window.partitionBy(*_GROUP).orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)
    leading = classes.withColumn("before", F.coalesce(F.sum("m").over(above), F.lit(0))).where(F.col("before") < top).drop("m")
    wanted = valued.join(leading, [*_GROUP, "value"]).select(*cell, "value", "before")
    place = F.row_number().over(Window.partitionBy(*_GROUP, "value").orderBy("term"))
    return (
        rows.join(wanted, cell)
        .withColumn("place", place)
        .where(F.col("place") <= top)
        .withColumn("rank", (F.col("before") + F.col("place")).cast("int"))
        .where(F.col("rank") <= top)
        .select(*_GROUP, F.col("term").alias("item"), "value", "rank")
    )


def audit(
    docs: DataFrame,
    least_docs: int = LEAST_DOCS,
    top: int = TOP_TERMS,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """``lang, source, part, item, value, rank`` of both parts: ``pair`` (other sources, all ranks) and ``term`` (up to ``top``).

    Null texts, languages and sources count as empty ones, repeated rows each for itself; a group
    without kept terms has the value 0 against every other group of a language without any; an
    empty table gives an empty result; other columns play no part.  The result has a row for
    every ordered pair of sources of a language; a term's row holds one entry per source at most.
    """
    counts = cut_lineage(term_counts(docs, text_col, lang_col, source_col))
    kept = cut_lineage(kept_terms(counts, least_docs))
    groups = cut_lineage(_groups(counts, kept))
    order = Window.partitionBy(*_GROUP).orderBy(F.desc("value"), "item")
    pairs = source_divergence(kept, groups).withColumn("rank", F.row_number().over(order).cast("int"))
    terms = term_divergence(kept, groups, top)
    return pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term"))).select(*_GROUP, "part", "item", "value", "rank")
