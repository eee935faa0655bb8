"""Secret spans: fixed patterns, and values in a credential context whose guessing cost is high.

The cost of a value is the least number of guesses over all ways to cut it into known words,
dates, repeats, keyboard walks and brute-force runs, found by dynamic programming.  Words are
those of the corpus, ranked by the documents that hold them: the substrings of the few
values in question are joined to the counts, so no word list travels.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridweave.durable import cut_lineage
from gridweave.llm.common import Columns, id_text, map_columns, per_row

KINDS = ("assign", "access", "hex", "guess")

# The base patterns.
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
# Words that announce a credential, and what may stand between them and the value.
_CONTEXT = re.compile(
    r"""(?i:pass(?:word|wd|phrase|code)|pwd|secret|token|api[ _-]?key|credentials?)["']?(?:\x20*[:=]\x20*|(\x20+is\x20+))["']?([^\s"',;]+)""",
    re.ASCII,
)
_HINTS = ("pass", "pwd", "secret", "token", "key", "credential")
# Common words of passwords and placeholders, most common first.
_WORDS = (
    "password pass admin love dragon monkey letmein welcome master login secret hello qwerty test user root guest changeme "
    "example token none null true false value your here insert string default sample dummy placeholder redacted hidden key "
    "the and for with this that summer winter spring autumn sun moon star king queen baby angel princess football baseball "
    "shadow michael super batman trust money freedom whatever computer internet server access public private api"
).split()
_RANK = {w: i + 1 for i, w in enumerate(_WORDS)}
# Lengths of words that a value is searched for, and documents that a word of the corpus must be in.
_SHORTEST, _LONGEST = 3, 20
LEAST_DOCS = 5
# Words that a task holds before it sends their counts on.
_HELD_WORDS = 500_000
# Letters become small, whatever is no letter a space; bytes of longer UTF-8 characters stay.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
# Rows of a keyboard.
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_NEXT = {(a, b) for row in _ROWS for a, b in zip(row, row[1:], strict=False)} | {(b, a) for row in _ROWS for a, b in zip(row, row[1:], strict=False)}
# Characters that stand for letters.
_PLAIN = str.maketrans("013457@$!", "oleastasi")

MIN_LOG10_GUESSES = 10.0
_STEP = math.log10(2)  # each further piece doubles the guesses
# A repeat writes a block of up to so many characters 2 to _TIMES times, or as often as it goes on; a walk has _WALK
# characters to _TIMES, or as many as it goes on.
_BLOCK, _TIMES, _WALK = 64, 16, 4


def _char_cost(c: str) -> float:
    return 1.0 if c.isdigit() else math.log10(26) if c.isalpha() else math.log10(33)


def _lengths(least: int, most: int) -> Iterator[int]:
    """``most``, and the numbers from ``least`` to ``_TIMES`` below it; nothing where ``most`` is below ``least``."""
    yield from range(least, min(most - 1, _TIMES) + 1)
    if most >= least:
        yield most


def word_guesses(value: str, start: int, end: int, ranks: Mapping[str, int]) -> float | None:
    """log10 guesses for the part of ``value`` as a word: its rank, twice that with capitals, four times that with letters written as digits."""
    part = value[start:end]
    low = part.lower()
    found = []
    for word, more in ((low, 1), (low.translate(_PLAIN), 4)):
        rank = min(_RANK.get(word, 1 << 62), ranks.get(word, 1 << 62))
        if rank < 1 << 62:
            found.append(math.log10(rank * more * (1 if low == part else 2)))
    return min(found, default=None)


def pieces(value: str, ranks: Mapping[str, int]) -> Iterator[list[tuple[int, float]]]:
    """All words, dates, repeats and walks in ``value``: for each start in order, (end, log10 guesses).

    The same rules hold for values of any length.  Only the pieces of one start are held at a time.
    """
    n, low = len(value), value.lower()
    brute = [0.0]
    for c in value:
        brute.append(brute[-1] + _char_cost(c))
    # Per size of a repeated block, the first place from here on whose character does not come again so much later.
    sizes = range(1, min(_BLOCK, n // 2) + 1)
    ends = dict.fromkeys(sizes, -1)
    turn = -1  # the first place from here on where a walk ends
    for i in range(n):
        here: list[tuple[int, float]] = []
        for j in range(i + _SHORTEST, min(n, i + _LONGEST) + 1):
            cost = word_guesses(value, i, j, ranks)
            if cost is not None:
                here.append((j, cost))
        for rule in _DATES:
            m = rule.match(value, i)
            if m:
                here.append((m.end(), math.log10(120 if m.end() - i == 4 else 365 * 120)))
        if turn < i:
            turn = i
            while turn < n - 1 and (low[turn], low[turn + 1]) in _NEXT:
                turn += 1
        here += [(i + k, math.log10(47 * k)) for k in _lengths(_WALK, turn - i + 1)]
        for size in sizes:
            if i >= n - size:
                break
            end = ends[size]
            if end < i:
                end = i
                while end < n - size and value[end] == value[end + size]:
                    end += 1
                ends[size] = end
            # Two of a single character are no shorter to say than to write.
            for times in _lengths(3 if size == 1 else 2, 1 + (end - i) // size):
                here.append((i + size * times, brute[i + size] - brute[i] + math.log10(times)))
        yield here


# Written days, with and without marks, and years.
_DATES = [
    re.compile(p)
    for p in (
        r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])",
        r"(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d",
        r"(?:19|20)\d\d",
    )
]


def guess_cost(value: str, ranks: Mapping[str, int] | None = None) -> float:
    """log10 of the least number of guesses over all cuts of ``value`` into pieces and brute-force runs; ``ranks`` are words and their ranks.

    Each piece after the first doubles the guesses; neighboring brute-force characters are one piece.
    """
    n = len(value)
    if not n:
        return 0.0
    best = [0.0] + [math.inf] * n
    brute = [math.inf] * (n + 1)  # the last piece is a brute-force run that is still open
    for i, found in enumerate(pieces(value, ranks or {})):
        here = min(best[i], brute[i])
        start = here + (_STEP if i else 0.0)
        brute[i + 1] = min(brute[i + 1], min(brute[i], start) + _char_cost(value[i]))
        for j, cost in found:
            best[j] = min(best[j], start + cost)
    return min(best[n], brute[n])


def substrings(value: str) -> set[str]:
    """What of a value may be a word of the corpus: its parts of letters, also where digits and signs stand for some."""
    out = set()
    for text in {value.lower(), value.lower().translate(_PLAIN)}:
        for i in range(len(text)):
            for j in range(i + 1, min(len(text), i + _LONGEST) + 1):
                if not text[j - 1].isalpha():
                    break
                if j - i >= _SHORTEST:
                    out.add(text[i:j])
    return out


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, value start, value end) of the fixed patterns, by start and kind."""
    out = []
    if _hinted(text):
        out += [(m.start(), 0, m.end(), m.start(2), m.end(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end(), m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _hinted(text: str) -> bool:
    low = text.lower()
    return any(h in low for h in _HINTS)


def candidates(text: str) -> list[tuple[int, int]]:
    """Values in a credential context, as (start, end).

    After "is" a value of letters alone, small but for the first, is an ordinary word of a sentence.
    """
    if not _hinted(text):
        return []
    out = []
    for m in _CONTEXT.finditer(text):
        value = m[2].rstrip(".:!?)]}>")
        plain = value.isalpha() and value[1:] == value[1:].lower()
        if len(value) >= 4 and not (m[1] and plain):
            out.append((m.start(2), m.start(2) + len(value)))
    return out


def word_ranks(docs: DataFrame, asked: DataFrame, text_col: str = "text", least_docs: int = LEAST_DOCS) -> DataFrame:
    """``(word, rank)`` of the words of ``asked`` that at least ``least_docs`` documents hold outside credential values.

    A word's rank is one more than the number of words in more documents.  All words are
    counted, by task first; ranks come from a small table of counts of counts.
    """

    def make():
        held: dict[bytes, int] = {}

        def flush() -> Columns:
            out = {"word": list(held), "n": list(held.values())}
            held.clear()
            return out

        def work(given: Columns | None) -> Iterator[Columns]:
            if given is None:
                yield flush()
                return
            for text in given["text"]:
                found = candidates(text)
                if found:
                    at, kept = 0, []
                    for s, e in found:
                        kept.append(text[at:s])
                        at = e
                    text = " ".join([*kept, text[at:]])
                for word in set(text.encode().translate(_LETTERS).split()):
                    if _SHORTEST <= len(word) <= 4 * _LONGEST:
                        held[word] = held.get(word, 0) + 1
                if len(held) >= _HELD_WORDS:
                    yield flush()

        return work

    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = map_columns(texts, make, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_docs)
    counts = cut_lineage(counts)
    sizes = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words"))
    # One row per count that occurs.
    above = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.withColumn("rank", F.coalesce(F.sum("words").over(above), F.lit(0)) + 1).drop("words")
    return counts.join(asked.select("word").distinct(), "word").join(ranked, "n").select("word", "rank")


def value_costs(values: DataFrame, docs: DataFrame, text_col: str = "text", least_docs: int = LEAST_DOCS) -> DataFrame:
    """``(value, cost)`` of the distinct values of ``values``, a written table, with the words of ``docs``."""
    one = cut_lineage(values.select("value").where("value IS NOT NULL").distinct())
    if not one.head(1):
        return one.withColumn("cost", F.lit(0.0))
    parts = per_row(lambda g: {"value": g["value"], "words": [sorted(substrings(v)) for v in g["value"]]})
    asked = cut_lineage(map_columns(one, parts, "value string, words array<string>").select("value", F.explode_outer("words").alias("word")))
    ranks = word_ranks(docs, asked.where("word IS NOT NULL"), text_col, least_docs)
    # A value has at most 40 parts a character.
    known = asked.join(ranks, "word", "left").groupBy("value").agg(
        F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("word", "rank"))).alias("known")
    )

    def costs(given: Columns) -> Columns:
        ranks_of = [{k["word"]: k["rank"] for k in known_} for known_ in given["known"]]
        return {"value": given["value"], "cost": [guess_cost(v, r) for v, r in zip(given["value"], ranks_of, strict=True)]}

    return map_columns(known, per_row(costs), "value string, cost double")


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _found(docs: DataFrame) -> DataFrame:
    """``text`` replaced by ``base`` (start, kind, end), ``inside`` (values of base spans) and ``maybe`` (candidates with their values)."""
    keep = [f for f in docs.schema.fields if f.name != "text"]
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)

    def rows(given: Columns) -> Columns:
        base = [base_spans(t) for t in given["text"]]
        maybe = [[{"s": s, "e": e, "value": t[s:e]} for s, e in candidates(t)] for t in given["text"]]
        return {f.name: given[f.name] for f in keep} | {
            "base": [[{"s": s, "k": k, "e": e} for s, k, e, _, _ in found] for found in base],
            "inside": [[t[a:b] for _, _, _, a, b in found] for t, found in zip(given["text"], base, strict=True)],
            "maybe": maybe,
        }

    return map_columns(docs, per_row(rows), f"{kind}, base array<struct<s:int,k:int,e:int>>, inside array<string>, maybe array<struct<s:int,e:int,value:string>>")


def _costed(found: DataFrame, docs: DataFrame, text_col: str, min_cost: float, least_docs: int) -> DataFrame:
    """``_row, spans`` (all spans in order) and the highest costs of context values and of base values, for the rows of ``found`` that have any value."""
    values = found.select("_row", F.explode("maybe").alias("m")).select("_row", "m.s", "m.e", "m.value", F.lit(True).alias("context"))
    inside = found.select("_row", F.explode("inside").alias("value")).select("_row", F.lit(0).alias("s"), F.lit(0).alias("e"), "value", F.lit(False).alias("context"))
    asked = cut_lineage(values.unionByName(inside))
    costs = value_costs(asked, docs, text_col, least_docs)
    priced = asked.join(costs, "value").groupBy("_row").agg(
        F.collect_list(F.when(F.col("context") & (F.col("cost") >= min_cost), F.struct("s", F.lit(3).alias("k"), "e"))).alias("guesses"),
        F.max(F.when(F.col("context"), F.col("cost"))).alias("max_context"),
        F.max(F.when(~F.col("context"), F.col("cost"))).alias("max_base"),
    )
    covered = F.filter("guesses", lambda g: ~F.exists("base", lambda b: (b["s"] <= g["s"]) & (g["e"] <= b["e"])))
    spans = F.array_sort(F.concat("base", F.coalesce(F.when(F.col("guesses").isNotNull(), covered), F.array().cast("array<struct<s:int,k:int,e:int>>"))))
    most = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("max_context", "max_base")}
    return found.drop("inside", "maybe").join(priced, "_row", "left").withColumns({"spans": spans, **most}).drop("guesses")


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_cost: float = MIN_LOG10_GUESSES, least_docs: int = LEAST_DOCS
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, spans per kind, their digest and the highest guessing costs.

    A context value is a span of its own where its cost is high and no base span holds it whole;
    values of base spans are costed too (``base_log10_guesses``), which leaves their spans alone.  Null and
    empty texts have no spans and the digest of the empty string.  A null id stays null; repeated rows
    give repeated results; an empty table gives an empty one.  Whole texts are read; only what
    is found in them, not the texts, is written and joined.
    """
    found = cut_lineage(_found(id_text(docs, id_col, text_col).withColumn("_row", F.monotonically_increasing_id())))
    priced = _costed(found, docs, text_col, min_cost, least_docs)

    def rows(given: Columns) -> Columns:
        spans = [[(x["s"], x["k"], x["e"]) for x in f] for f in given["spans"]]
        base = [[x for x in f if x[1] < 3] for f in spans]
        return {
            "doc_id": given["doc_id"],
            **{f"n_{KINDS[k]}": [sum(x[1] == k for x in f) for f in spans] for k in range(4)},
            "base_sha256": [hashlib.sha256(_joined(b).encode()).hexdigest() for b in base],
            "spans": [_joined(f) for f in spans],
            "max_log10_guesses": given["max_context"],
            "base_log10_guesses": given["max_base"],
        }

    return map_columns(
        priced.select("doc_id", "spans", "max_context", "max_base"),
        per_row(rows),
        "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string, max_log10_guesses double, base_log10_guesses double",
    )


def _masked(text: str, spans: list, mask: str) -> str:
    out, at = [], 0
    for x in spans:
        if x["s"] >= at:
            out += [text[at : x["s"]], mask]
        at = max(at, x["e"])
    return "".join([*out, text[at:]])


def redact(
    docs: DataFrame, text_col: str = "text", min_cost: float = MIN_LOG10_GUESSES, mask: str = "[SECRET]", least_docs: int = LEAST_DOCS
) -> DataFrame:
    """``docs`` with every span replaced by ``mask``; overlapping spans become one.  Other columns, nulls and row counts stay.

    Only texts with a span or a candidate are written and joined; all others pass as they are.
    """
    names = docs.columns

    def flags(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([bool(t) and bool(candidates(t) or base_spans(t)) for t in texts], dtype=bool)

    def masks(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, spans in parts:
            yield pd.Series([_masked(t, f, mask) for t, f in zip(texts, spans, strict=True)], dtype=object)

    flag = F.pandas_udf(flags, "boolean")(F.col(text_col))
    whole = F.struct(*[F.col(c) for c in names]).alias("_doc")
    some = cut_lineage(docs.where(flag).select(whole, F.monotonically_increasing_id().alias("_row")))
    found = cut_lineage(_found(some.select("_row", F.col(f"_doc.{text_col}").alias("text"))))
    spans = _costed(found, docs, text_col, min_cost, least_docs).select("_row", "spans")
    met = some.join(spans, "_row").withColumn("_text", F.pandas_udf(masks, "string")(F.col(f"_doc.{text_col}"), F.col("spans")))
    masked = met.select(*[F.col("_text").alias(c) if c == text_col else F.col("_doc")[c].alias(c) for c in names])
    return docs.where(~flag).unionByName(masked)
