"""Quality classifier by co-training of two views: the text itself, and what is known around it.

Each view has a logistic model.  In each round both label the unlabelled pool and hand their most
confident rows to the other one.  Calibrated on labelled rows that were held out, the two views
are combined by their held-out loss.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import Columns, labelled_sample, map_columns, per_row

# Bounds of what the driver sees: labelled rows and unlabelled rows, as short feature vectors.
MAX_LABELLED = 20_000
POOL = 20_000
ROUNDS = 5
GIVEN = 200  # rows a view hands over per round

_SOURCES, _LANGS = 32, 8
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = b"0123456789"
# The symbols that mark broken or generated text.
_SYMBOLS = b"#*$%&|<>"


def _log(x: float) -> float:
    return math.log1p(x)


def text_view(text: str) -> list[float]:
    """Shares of character classes and the repetitiveness of a whole text."""
    raw = text.encode()
    n = len(raw) + 40  # so that a few words do not give extreme shares
    words = raw.lower().split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    w = len(words) + 8
    counts = Counter(words)
    gone = lambda chars: (len(raw) - len(raw.translate(None, chars))) / n
    return [
        gone(_UPPER),
        gone(_LOWER),
        gone(_DIGIT),
        gone(_SYMBOLS),
        raw.count(b"!") / n,
        raw.count(b"|") / w,
        raw.count(b". ") / w,
        raw.count(b",") / w,
        _log(sum(map(len, words)) / w),
        (len(counts) + 8) / w,
        max(counts.values(), default=0) / w,
        1 - len(set(lines)) / max(1, len(lines)),
        float(len(set(words[: w // 2]) & set(words[w // 2 :])) / max(1, len(counts))),
    ]


def metadata_view(source: str | None, lang: str | None, text: str) -> list[float]:
    """Where a document comes from, its language and its layout: sizes and line counts only."""
    lines = text.count("\n") + 1
    out = [_log(len(text)), _log(lines), _log(len(text) / lines), _log(text.count(" ") / lines), len(text.encode()) / max(1, len(text)) - 1]
    hot = [0.0] * (_SOURCES + _LANGS)
    if source is not None:
        hot[zlib.crc32(source.encode()) % _SOURCES] = 1.0
    if lang is not None:
        hot[_SOURCES + zlib.crc32(lang.encode()) % _LANGS] = 1.0
    return out + hot


@dataclass(frozen=True)
class View:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0  # calibration of the margin
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.margin(x) + self.shift


@dataclass(frozen=True)
class CoTrained:
    text: View
    meta: View
    text_share: float


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _newton(x: np.ndarray, y: np.ndarray, l2: float, steps: int = 25) -> np.ndarray:
    """Logistic weights, the last one the bias; both classes weigh the same but for a square root."""
    x = np.column_stack([x, np.ones(len(x))])
    share = np.clip(y.mean(), 0.01, 0.99)
    weight = np.where(y > 0, share**-0.5, (1 - share) ** -0.5)
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], l2)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = _sigmoid(x @ w)
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, x.T @ (weight * (p - y)) + ridge * w)
        w = w - step * min(1.0, 10 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _fit(x: np.ndarray, y: np.ndarray) -> View:
    mean, scale = x.mean(0), x.std(0) + 1e-6
    w = _newton(np.clip((x - mean) / scale, -8, 8), y, 1.0)
    return View(mean, scale, w[:-1], float(w[-1]))


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray, rounds: int = ROUNDS, given: int = GIVEN) -> CoTrained:
    """Two models that label for each other; every fifth labelled row is kept for calibration."""
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    test = held if held.any() else ~held
    views, data, pools = [], [text, meta], [pool_text, pool_meta]
    own = [(x[~held], y[~held]) for x in data]
    free = [np.ones(len(pool_text), bool), np.ones(len(pool_text), bool)]
    share = float(np.clip(y.mean(), 0.05, 0.95))
    for step in range(rounds + 1):
        views = [_fit(*o) for o in own]
        if step == rounds or not len(pool_text):
            break
        for k in (0, 1):
            m = views[k].margin(pools[k])
            other = 1 - k
            order = np.argsort(m, kind="stable")
            order = order[free[other][order]]
            low, high = order[: round(given * (1 - share))], order[::-1][: round(given * share)]
            low, high = low[m[low] < -2], high[m[high] > 2]  # only confident ones
            took = np.concatenate([low, high])
            free[other][took] = False
            label = np.concatenate([np.zeros(len(low)), np.ones(len(high))])
            own[other] = (np.concatenate([own[other][0], pools[other][took]]), np.concatenate([own[other][1], label]))
    done, loss = [], []
    for v, x in zip(views, data, strict=True):
        w = _newton(v.margin(x[test])[:, None], y[test], 1e-2)
        # The square-root weights move the bias; undo that so that scores are probabilities.
        v = View(v.mean, v.scale, v.weights, v.bias, float(w[0]), float(w[1]))
        p = np.clip(_sigmoid(v.calibrated(x[test])), 1e-6, 1 - 1e-6)
        done.append(v)
        loss.append(float(-(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p)).mean()))
    inverse = [1 / (x + 1e-3) for x in loss]
    return CoTrained(done[0], done[1], inverse[0] / sum(inverse))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", label_col: str = "quality", max_labelled: int = MAX_LABELLED, pool: int = POOL) -> CoTrained | None:
    """A model from at most ``max_labelled`` labelled rows and about ``pool`` others; None without both labels."""
    keep = [id_col, text_col, source_col, lang_col]
    rows = docs.count()
    labelled = labelled_sample(docs, labels, [label_col], max_labelled, id_col, keep).select(*keep, F.col(f"_{label_col}").alias("y"))
    share = min(1.0, pool / max(rows, 1))
    spread = F.pmod(F.xxhash64(F.lit("pool"), id_col), F.lit(1 << 30)) < F.lit(round(share * (1 << 30)))
    others = docs.where(spread).select(*keep, F.lit(None).cast("int").alias("y"))

    def rows_of(given: Columns) -> Columns:
        return {
            "doc_id": given["doc_id"],
            "y": given["y"],
            "t": [text_view(t) for t in given["text"]],
            "m": [metadata_view(s, g, t) for s, g, t in zip(given["source"], given["lang"], given["text"], strict=True)],
        }

    both = _inputs(labelled.unionByName(others), keep, ["y"])
    # As Arrow columns: rows of Python numbers take many times the memory, which the driver does not give back.
    seen = map_columns(both, per_row(rows_of), "doc_id long, y int, t array<double>, m array<double>").orderBy(F.xxhash64("doc_id"), "doc_id", "y").toArrow().combine_chunks()
    y = seen["y"].to_numpy().astype(float)
    known = (y == 0) | (y == 1)
    if len(set(y[known])) < 2:
        return None
    free = np.isnan(y) & ~pc.is_in(seen["doc_id"], value_set=seen["doc_id"].filter(pa.array(known))).to_numpy()
    text, meta = (pc.list_flatten(seen[c]).to_numpy().reshape(len(y), -1) for c in ("t", "m"))
    return co_train(text[known], meta[known], y[known], text[free], meta[free])


def _inputs(docs: DataFrame, names: list[str], more: list[str] = ()) -> DataFrame:
    """The columns under fixed names; source and lang may be missing."""
    id_col, text_col, source_col, lang_col = names
    have = {c.lower() for c in docs.columns}
    opt = lambda c: F.col(c).cast("string") if c.lower() in have else F.lit(None).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), opt(source_col).alias("source"), opt(lang_col).alias("lang"), *more)


def _scores(model: CoTrained | None, texts: list[str], sources: list, langs: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    blank = np.array([not t.strip() for t in texts], bool)
    if model is None or not texts:
        return (np.where(blank, 0.0, 1.0),) * 3
    mt = model.text.calibrated(np.array([text_view(t) for t in texts]))
    mm = model.meta.calibrated(np.array([metadata_view(*x) for x in zip(sources, langs, texts, strict=True)]))
    z = model.text_share * mt + (1 - model.text_share) * mm
    return tuple(np.where(blank, 0.0, _sigmoid(v)) for v in (mt, mm, z))


def passes(model: CoTrained | None, text_col: str = "text", source_col: str = "source", lang_col: str = "lang", min_score: float = 0.5) -> Column:
    """``kept`` of ``score`` as a column."""

    def flags(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for texts, sources, langs in parts:
            s = _scores(model, *([x if isinstance(x, str) else d for x in col] for col, d in ((texts, ""), (sources, None), (langs, None))))[2]
            yield pd.Series((s > 0) & (s >= min_score))

    return F.pandas_udf(flags, "boolean")(F.col(text_col), F.col(source_col).cast("string"), F.col(lang_col).cast("string"))


def score(docs: DataFrame, model: CoTrained | None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", min_score: float = 0.5) -> DataFrame:
    """``doc_id, text_score, meta_score, score, kept`` of every row; whole texts are read.

    A text without a word has score 0 and is rejected.  Null source or language is its own case;
    without a model every text with a word is kept with score 1.  Null ids stay, repeated rows are
    scored each, an empty table gives an empty one.
    """

    def rows(given: Columns) -> Columns:
        a, b, s = _scores(model, given["text"], given["source"], given["lang"])
        return {"doc_id": given["doc_id"], "text_score": a.tolist(), "meta_score": b.tolist(), "score": s.tolist(), "kept": ((s > 0) & (s >= min_score)).tolist()}

    return map_columns(_inputs(docs, [id_col, text_col, source_col, lang_col]), per_row(rows), "doc_id long, text_score double, meta_score double, score double, kept boolean")
