"""Severity of toxic language by cumulative-link (proportional odds) regression on sparse text features.

Features are hashed words and word beginnings.  One weight vector serves all ordered
thresholds: P(grade <= k) = sigmoid(theta_k - w.x), and the expected severity is the sum of
P(grade > k) over k.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.durable import cut_lineage
from gridweave.llm.common import Columns, id_text, labelled_sample, map_columns, per_row, worker_store

_WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6, 7, 8)
# Bounds of the training sample and of the features kept from it.
MAX_LABELLED = 20_000
MAX_FEATURES = 1024
MIN_DF = 5


@dataclass(frozen=True)
class OrdinalModel:
    features: dict[int, int]  # hashed feature -> position
    weights: np.ndarray
    thresholds: np.ndarray
    length_weight: float


def word_features(word: str) -> tuple[int, ...]:
    """Hashes of a lower-case word and of its beginnings."""
    return tuple(zlib.crc32(x.encode()) for x in dict.fromkeys([f"={word}", *(word[:k] for k in PREFIXES if len(word) >= k)]))


def _features_of(text: str, known: dict | None, seen: dict) -> tuple[Counter, int]:
    """Counts of the features (of ``known`` only, by position) and the number of words."""
    counts: Counter = Counter()
    words = _WORD.findall(text.lower())
    for w, n in Counter(words).items():
        ids = seen.get(w)
        if ids is None:
            ids = word_features(w)
            if known is not None:
                ids = tuple(known[i] for i in ids if i in known)
            if len(seen) >= 400_000:
                seen.clear()
            seen[w] = ids
        for i in ids:
            counts[i] += n
    return counts, len(words)


def fit_ordinal(rows: list[dict[int, float]], extra: np.ndarray, grades: np.ndarray, n_features: int, n_grades: int, l2: float = 0.3, steps: int = 400):
    """Weights, thresholds and the weight of ``extra``, by Adam on the whole (bounded) sample."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.fromiter((i for r in rows for i in r), np.int64, len(at))
    val = np.fromiter((v for r in rows for v in r.values()), np.float64, len(at))
    n, k = len(rows), n_grades - 1
    share = np.clip([np.mean(grades <= j) for j in range(k)], 0.01, 0.999)
    first = np.log(share / (1 - share))
    p = np.zeros(n_features + 1 + k)
    p[n_features + 1] = first[0]
    p[n_features + 2 :] = np.log(np.maximum(np.diff(first), 0.05))
    m, v = np.zeros_like(p), np.zeros_like(p)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, steps + 1):
        w, c, gaps = p[:n_features], p[n_features], np.exp(p[n_features + 2 :])
        theta = p[n_features + 1] + np.concatenate([[0.0], np.cumsum(gaps)])
        eta = np.bincount(at, w[col] * val, n) + c * extra
        below = np.concatenate([np.zeros((n, 1)), sig(theta - eta[:, None]), np.ones((n, 1))], axis=1)
        prob = np.maximum(below[np.arange(n), grades + 1] - below[np.arange(n), grades], 1e-9)
        slope = below * (1 - below)
        up, down = slope[np.arange(n), grades + 1] / prob, slope[np.arange(n), grades] / prob
        d_eta = (up - down) / n
        d_theta = np.array([(-(up * (grades == j)) + down * (grades == j + 1)).sum() / n for j in range(k)])
        g = np.concatenate([np.bincount(col, d_eta[at] * val, n_features) + l2 * w / n, [d_eta @ extra], [d_theta.sum()], [d_theta[j + 1 :].sum() * gaps[j] for j in range(k - 1)]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    theta = p[n_features + 1] + np.concatenate([[0.0], np.cumsum(np.exp(p[n_features + 2 :]))])
    return p[:n_features], theta, float(p[n_features])


def _value(count: int) -> float:
    return math.log1p(count)


def train(docs: DataFrame, graded: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", max_labelled: int = MAX_LABELLED, max_features: int = MAX_FEATURES, min_df: int = MIN_DF) -> OrdinalModel | None:
    """A model from at most ``max_labelled`` rows of ``graded`` (id, grade 0, 1, ...); None without two different grades.

    The features are those whose presence differs most between grade 0 and above, by a two-sample z score.
    """
    sample = cut_lineage(labelled_sample(docs, graded, [grade_col], max_labelled, id_col, [id_col, text_col]).select(F.coalesce(text_col, F.lit("")).alias("text"), F.col(f"_{grade_col}").alias("grade")))
    sizes = {r["grade"]: r["count"] for r in sample.groupBy("grade").count().collect()}
    clean, total = sizes.get(0, 0), sum(sizes.values())
    if len(sizes) < 2 or min(sizes) < 0:
        return None

    def present(given: Columns) -> Columns:
        seen = worker_store("toxicity words")
        out: Columns = {"feature": [], "clean": [], "toxic": []}
        tally: dict[int, list[int]] = {}
        for text, grade in zip(given["text"], given["grade"], strict=True):
            for i in _features_of(text, None, seen)[0]:
                tally.setdefault(i, [0, 0])[grade > 0] += 1
        for i, (a, b) in tally.items():
            out["feature"].append(i)
            out["clean"].append(a)
            out["toxic"].append(b)
        return out

    a, b = F.col("a") / max(clean, 1), F.col("b") / max(total - clean, 1)
    pooled = (F.col("a") + F.col("b")) / total
    z = F.abs(a - b) / F.sqrt(pooled * (1 - pooled) * (1 / max(clean, 1) + 1 / max(total - clean, 1)) + 1e-9)
    kept = (
        map_columns(sample, per_row(present), "feature long, clean long, toxic long")
        .groupBy("feature")
        .agg(F.sum("clean").alias("a"), F.sum("toxic").alias("b"))
        .where(F.col("a") + F.col("b") >= min_df)
        .orderBy(z.desc(), "feature")
        .limit(max_features)
    )
    known = {r["feature"]: i for i, r in enumerate(kept.select("feature").collect())}

    def sparse(given: Columns) -> Columns:
        seen: dict = {}
        found = [_features_of(t, known, seen) for t in given["text"]]
        return {"grade": given["grade"], "words": [n for _, n in found], "at": [list(c) for c, _ in found], "n": [list(c.values()) for c, _ in found]}

    rows = map_columns(sample, per_row(sparse), "grade int, words int, at array<int>, n array<int>").orderBy("words", "grade", "at", "n").collect()
    order = {g: i for i, g in enumerate(sorted(sizes))}
    w, theta, length = fit_ordinal(
        [dict(zip(r["at"], map(_value, r["n"]), strict=True)) for r in rows],
        np.array([math.log1p(r["words"]) for r in rows]),
        np.array([order[r["grade"]] for r in rows]),
        len(known),
        len(sizes),
    )
    return OrdinalModel(known, w, theta, length)


def score(docs: DataFrame, model: OrdinalModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, expected_severity, p_toxic, grade, toxic`` of every row.

    ``grade`` is the likeliest one and ``toxic`` says that a grade above 0 is likelier than 0.
    Whole texts are read.  Without a model, and for a null or empty text, the severity is 0.
    Null ids stay, repeated rows are scored each, an empty table gives an empty one.
    """

    def rows(given: Columns) -> Columns:
        seen: dict = worker_words
        out: Columns = {k: [] for k in ("doc_id", "expected_severity", "p_toxic", "grade", "toxic")}
        for doc, text in zip(given["doc_id"], given["text"], strict=True):
            above = np.zeros(1)
            if model is not None and text:
                counts, n = _features_of(text, model.features, seen)
                eta = sum(model.weights[i] * _value(c) for i, c in counts.items()) + model.length_weight * math.log1p(n)
                above = 1 / (1 + np.exp(np.clip(model.thresholds - eta, -40, 40)))
            prob = -np.diff(np.concatenate([[1.0], above, [0.0]]))
            for k, v in zip(out, (doc, float(above.sum()), float(above[0]), int(prob.argmax()), bool(above[0] >= 0.5)), strict=True):
                out[k].append(v)
        return out

    worker_words: dict = {}
    return map_columns(id_text(docs, id_col, text_col), per_row(rows), "doc_id long, expected_severity double, p_toxic double, grade int, toxic boolean")
