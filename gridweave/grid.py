"""The dyadic grid that every box table is keyed on.

A grid is one-row metadata: the domain box of a point table plus its row count.
Cell keys are integers.  A cell at depth ``L`` is ``floor((x - lo) / width * 2^L)``
per axis, so the cell of a coarser depth is a right shift of the finer one and no
recursion over boxes is ever needed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Relative / absolute widening of the upper domain edge.
EDGE_REL = 1e-9
EDGE_ABS = 1e-12
# Deepest usable depth per dimension: d * depth bits of a box code fit a LONG.
FINEST = {2: 26, 3: 20}


@dataclass(frozen=True)
class Grid:
    """Domain box of a point table and the key arithmetic on top of it."""

    axes: tuple[str, ...]
    lo: tuple[float, ...]
    top: tuple[float, ...]
    n: int

    def __post_init__(self) -> None:
        if len(self.axes) not in FINEST:
            raise ValueError(f"points must have 2 or 3 axes, got {len(self.axes)}")
        if not len(self.axes) == len(self.lo) == len(self.top):
            raise ValueError("axes, lo and top must have the same length")

    @classmethod
    def fit(cls, points: DataFrame, axes: Sequence[str] = ("x", "y")) -> Grid:
        """Measure the domain of ``points`` with one min/max/count job."""
        axes = tuple(axes)
        if len(axes) not in FINEST:
            raise ValueError(f"points must have 2 or 3 axes, got {len(axes)}")
        aggs = [F.count(F.lit(1)).alias("n")]
        for ax in axes:
            aggs += [F.min(ax).alias(f"{ax}_min"), F.max(ax).alias(f"{ax}_max")]
        row = points.agg(*aggs).first()
        if row["n"] == 0:
            raise ValueError("cannot fit a grid to an empty point table")
        lo = tuple(float(row[f"{ax}_min"]) for ax in axes)
        top = tuple(float(row[f"{ax}_max"]) for ax in axes)
        return cls(axes, lo, top, int(row["n"]))

    # -- sizes -----------------------------------------------------------
    @property
    def d(self) -> int:
        return len(self.axes)

    @property
    def dof_row(self) -> int:
        return self.d

    @property
    def dof_col(self) -> int:
        return self.d - 1

    @property
    def finest(self) -> int:
        return FINEST[self.d]

    @property
    def keys(self) -> tuple[str, ...]:
        """Names of the integer cell columns."""
        return tuple("i" + c for c in ("x", "y", "z")[: self.d])

    @property
    def span(self) -> tuple[float, ...]:
        return tuple(top - lo for lo, top in zip(self.lo, self.top))

    @property
    def hi(self) -> tuple[float, ...]:
        """Upper domain edges, widened so that the largest point lies inside."""
        return tuple(top + (s * EDGE_REL if s > 0 else EDGE_ABS) for top, s in zip(self.top, self.span))

    @property
    def width(self) -> tuple[float, ...]:
        return tuple(hi - lo for lo, hi in zip(self.lo, self.hi))

    def check_depth(self, depth: int) -> int:
        if not 0 <= depth <= self.finest:
            raise ValueError(f"depth must be in [0, {self.finest}], got {depth}")
        return depth

    def depth_for(self, leaf_size: int) -> int:
        """Smallest uniform depth whose average box holds at most ``leaf_size`` points."""
        if leaf_size < 1:
            raise ValueError(f"leaf_size must be >= 1, got {leaf_size}")
        for depth in range(self.finest + 1):
            if self.n <= leaf_size << (self.d * depth):
                return depth
        return self.finest

    # -- column builders ---------------------------------------------------
    def cells(self, depth: int) -> list[Column]:
        """Cell index columns of a point row at ``depth``; a zero-span axis is always cell 0."""
        self.check_depth(depth)
        out = []
        for ax, key, lo, span, width in zip(self.axes, self.keys, self.lo, self.span, self.width):
            if span <= 0:
                out.append(F.lit(0).cast("bigint").alias(key))
                continue
            raw = F.floor((F.col(ax) - F.lit(lo)) / F.lit(width) * F.lit(float(2**depth)))
            out.append(F.least(F.greatest(raw, F.lit(0)), F.lit(2**depth - 1)).cast("bigint").alias(key))
        return out

    def coarsen(self, levels: Column | int, prefix: str = "") -> list[Column]:
        """Cell columns ``levels`` steps further up."""
        if isinstance(levels, int):
            levels = F.lit(levels)
        return [_shift(F.col(prefix + k), levels).alias(prefix + k) for k in self.keys]

    def code(self, depth: Column, prefix: str = "", cells: Sequence[Column] | None = None) -> Column:
        """Row-major box code, unique within a depth (axis 0 slowest)."""
        cells = list(cells) if cells is not None else [F.col(prefix + k) for k in self.keys]
        side = F.call_function("shiftleft", F.lit(1).cast("bigint"), depth.cast("int"))
        out = cells[0]
        for c in cells[1:]:
            out = out * side + c
        return out

    def morton(self, depth: int, prefix: str = "") -> Column:
        """Bit-interleaved key: sorting by it walks the boxes of one depth depth-first."""
        terms = [
            f"shiftleft(shiftright({prefix}{k}, {bit}) & 1L, {bit * self.d + self.d - 1 - a})"
            for bit in range(depth)
            for a, k in enumerate(self.keys)
        ]
        return F.expr(" | ".join(["0L", *terms]))

    def side(self, depth: Column) -> Column:
        """Number of cells per axis at ``depth`` as a double."""
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), depth.cast("int")).cast("double")

    def edges(self, depth: Column, prefix: str = "") -> list[tuple[Column, Column]]:
        """(low, high) edge columns of a box per axis."""
        side = self.side(depth)
        out = []
        for k, lo, width in zip(self.keys, self.lo, self.width):
            c = F.col(prefix + k).cast("double")
            low = F.lit(lo) + F.lit(width) * c / side
            high = F.lit(lo) + F.lit(width) * (c + F.lit(1.0)) / side
            out.append((low, high))
        return out

    def diam(self, depth: Column) -> Column:
        """Cell diagonal at ``depth``."""
        return F.lit(math.sqrt(sum(w * w for w in self.width))) / self.side(depth)


def _shift(col: Column, levels: Column) -> Column:
    return F.call_function("shiftright", col, levels.cast("int"))
