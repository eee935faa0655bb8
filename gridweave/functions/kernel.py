"""The regularized tensor kernel, as column expressions and for tiles of points."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from gridweave.functions.geometry import distance

# Fixed value: default regularization length.
DEFAULT_EPS = 1e-3


def kernel_block(x: Sequence[Column], y: Sequence[Column], eps: float = DEFAULT_EPS) -> list[tuple[int, int, Column]]:
    """``(row component, column component, value)`` of the block of target ``x`` and source ``y``.

    The block is ``(I + r r^T / (|r| + eps)^2) / (|r| + eps)^d``, its first ``d - 1`` columns.
    """
    d = len(x)
    if d not in (2, 3):
        raise ValueError(f"points must have 2 or 3 coordinates, got {d}")
    if eps <= 0:
        raise ValueError(f"eps must be > 0, got {eps}")
    den = distance(x, y) + F.lit(eps)
    scale = den * den if d == 2 else den * den * den
    out = []
    for a in range(d):
        for c in range(d - 1):
            outer = (x[a] - y[a]) * (x[c] - y[c]) / (den * den)
            out.append((a, c, (F.lit(1.0 if a == c else 0.0) + outer) / scale))
    return out


def kernel_tile(x: np.ndarray, y: np.ndarray, eps: float) -> np.ndarray:
    """Kernel blocks of one tile of targets and one of sources, shape (n, d, m, d - 1)."""
    d = x.shape[1]
    r = x[:, None, :] - y[None, :, :]
    den = np.sqrt((r * r).sum(axis=2)) + eps
    unit = r / den[:, :, None]
    block = unit[:, :, :, None] * unit[:, :, None, : d - 1]
    block += np.eye(d)[:, : d - 1]
    block /= (den**d)[:, :, None, None]
    return block.transpose(0, 2, 1, 3)
