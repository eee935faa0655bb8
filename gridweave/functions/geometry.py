"""Box predicates and distances as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TOUCH_TOL = 1e-9
DEFAULT_ETA = 0.5

Edges = Sequence[tuple[Column, Column]]


def _gaps(a: Edges, b: Edges) -> list[Column]:
    if len(a) != len(b):
        raise ValueError(f"boxes must have the same dimension, got {len(a)} and {len(b)}")
    return [F.greatest(alo - bhi, blo - ahi) for (alo, ahi), (blo, bhi) in zip(a, b)]


def boxes_adjacent(a: Edges, b: Edges, tol: float = TOUCH_TOL) -> Column:
    """Whether two general boxes touch or overlap on every axis."""
    return reduce(and_, [g <= F.lit(tol) for g in _gaps(a, b)])


def cells_adjacent(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Adjacency of two cells of one depth, in integers."""
    if len(a) != len(b):
        raise ValueError(f"cells must have the same dimension, got {len(a)} and {len(b)}")
    return reduce(and_, [F.abs(p - q) <= 1 for p, q in zip(a, b)])


def box_gap(a: Edges, b: Edges) -> Column:
    """Euclidean distance of two boxes, 0 when they touch."""
    squares = [F.greatest(g, F.lit(0.0)) * F.greatest(g, F.lit(0.0)) for g in _gaps(a, b)]
    return F.sqrt(reduce(lambda p, q: p + q, squares))


def is_admissible(gap: Column, diam_a: Column, diam_b: Column, eta: Column | float = DEFAULT_ETA) -> Column:
    """Strong admissibility of a pair of boxes."""
    eta = F.lit(eta) if isinstance(eta, (int, float)) else eta
    return gap >= eta * F.greatest(diam_a, diam_b)


def suggest_eta(gamma: Column | float = 0.1, target: Column | float = 1e-2, d: int = 3) -> Column:
    """Separation at which the kernel has decayed to ``target`` of its touching value."""
    if d not in (2, 3):
        raise ValueError(f"d must be 2 or 3, got {d}")
    for name, v, ok in (("gamma", gamma, lambda v: v >= 0), ("target", target, lambda v: 0 < v < 1)):
        if isinstance(v, (int, float)) and not ok(v):
            raise ValueError(f"{name} out of range: {v}")
    gamma = F.lit(float(gamma)) if isinstance(gamma, (int, float)) else gamma
    target = F.lit(float(target)) if isinstance(target, (int, float)) else target
    eta = F.greatest(gamma * (F.lit(1.0) / F.pow(target, F.lit(1.0 / d)) - F.lit(1.0)), F.lit(0.0))
    return F.when((gamma >= 0) & (target > 0) & (target < 1), eta)


def distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Euclidean distance of two points."""
    if len(a) != len(b):
        raise ValueError(f"points must have the same dimension, got {len(a)} and {len(b)}")
    return F.sqrt(reduce(lambda p, q: p + q, [(p - q) * (p - q) for p, q in zip(a, b)]))
