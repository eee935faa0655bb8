"""Leading eigenvalues of a symmetric matrix by spectrum slicing.

A factorization ``P (A - s I) P^T = L D L^T`` has as many positive pivots as ``A`` has
eigenvalues above ``s`` (inertia).  Halving a range of shifts by these counts isolates the k-th
largest eigenvalue, Rayleigh quotient iteration converges on it cubically, and two more counts
certify that it is the k-th.  Works on one small matrix in memory.
"""

from __future__ import annotations

import math

import numpy as np

EPS = float(np.finfo(float).eps)
# A pivot of a matrix of zeros; its inverse is still a number.
SMALL = 1e-140
# Fixed value: growth-balancing share for accepting a single pivot.
_SINGLE = (1 + math.sqrt(17)) / 8
_HALVINGS = 120
_QUOTIENT_STEPS = 30


class Inertia:
    """LDL^T of ``matrix - shift I`` with 1x1 and 2x2 pivots chosen over the whole remaining block."""

    def __init__(self, matrix: np.ndarray, shift: float):
        n = len(matrix)
        a = matrix - shift * np.eye(n)
        self.tiny = EPS * max(float(np.abs(matrix).max(initial=0.0)), abs(shift), SMALL)
        order = np.arange(n)
        self.lower = np.eye(n)
        self.blocks: list[np.ndarray] = []
        self.above = k = 0
        while k < n:
            rest = np.abs(a[k:, k:])
            diag = rest.diagonal()
            best = int(diag.argmax())
            off = rest - np.diag(diag)
            r, c = divmod(int(off.argmax()), n - k)
            size = 1 if diag[best] >= _SINGLE * off[r, c] else 2
            for to, at in enumerate([best] if size == 1 else sorted((r, c))):
                i, j = k + to, k + at
                if i != j:
                    a[[i, j]] = a[[j, i]]
                    a[:, [i, j]] = a[:, [j, i]]
                    order[[i, j]] = order[[j, i]]
                    self.lower[[i, j], :k] = self.lower[[j, i], :k]
            pivot = a[k : k + size, k : k + size].copy()
            if size == 1:
                self.above += int(pivot[0, 0] > 0)
                if abs(pivot[0, 0]) < self.tiny:  # the shift is an eigenvalue: solve with the smallest pivot instead
                    pivot[0, 0] = math.copysign(self.tiny, pivot[0, 0])
            else:
                self.above += 1  # such a block has one pivot of each sign
            below = a[k + size :, k : k + size]
            part = np.linalg.solve(pivot, below.T).T
            a[k + size :, k + size :] -= part @ below.T
            self.lower[k + size :, k : k + size] = part
            self.blocks.append(pivot)
            k += size
        self.order = order

    def solve(self, right: np.ndarray) -> np.ndarray:
        x = right[self.order].astype(float)
        n, low = len(x), self.lower
        for i in range(n):
            x[i] -= low[i, :i] @ x[:i]
        at = 0
        for pivot in self.blocks:
            x[at : at + len(pivot)] = np.linalg.solve(pivot, x[at : at + len(pivot)])
            at += len(pivot)
        for i in range(n - 1, -1, -1):
            x[i] -= low[i + 1 :, i] @ x[i + 1 :]
        out = np.empty(n)
        out[self.order] = x
        return out


def count_above(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues of ``matrix`` above ``shift``."""
    return Inertia(matrix, shift).above


def _apart(v: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    """``v`` without its part along the vectors found so far, of length 1; taken off twice against cancellation."""
    for _ in range(2):
        for u in found:
            v = v - (u @ v) * u
    size = np.linalg.norm(v)
    return v / size if size > 0 else v


def leading_eigenpairs(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues, falling, and their unit eigenvectors as columns.

    Eigenvalues closer than rounding are returned with orthonormal vectors of their common
    space.  Raises ``ArithmeticError`` where the counts do not certify a number.
    """
    n = len(matrix)
    count = min(count, n)
    scale = float(np.abs(matrix).max(initial=0.0))
    if not scale or not count:
        return np.zeros(count), np.eye(n)[:, :count]
    a = (matrix + matrix.T) / (2 * scale)
    radius = float(np.abs(a).sum(axis=1).max())
    noise = 4 * n * EPS * radius
    shifts: dict[float, int] = {}

    def above(shift: float) -> int:
        if shift not in shifts:
            shifts[shift] = count_above(a, shift)
        return shifts[shift]

    values: list[float] = []
    vectors: list[np.ndarray] = []
    tries = 0
    for k in range(1, count + 1):
        lo, hi = -radius - noise, radius + noise
        for shift, seen in shifts.items():  # earlier counts narrow the range
            if seen >= k:
                lo = max(lo, shift)
            else:
                hi = min(hi, shift)
        value, vector = (lo + hi) / 2, np.eye(n)[0]
        for _ in range(_HALVINGS):
            mid = (lo + hi) / 2
            alone = above(lo) == k and above(hi) == k - 1
            if hi - lo <= noise or (alone and hi - lo <= 1e-2 * max(abs(lo), abs(hi))):
                # Equal eigenvalues need starts with different parts in their space; these are fixed and unlike each other.
                tries += 1
                start = np.cos(np.arange(1, n + 1) ** 2 * (math.sqrt(2) * tries))
                value, vector, good = _quotient(a, (lo + hi) / 2, start, vectors, noise)
                if good and lo - noise <= value <= hi + noise:
                    break
                if hi - lo <= noise:
                    continue
            if above(mid) >= k:
                lo = mid
            else:
                hi = mid
        if above(value + noise) > k - 1 or above(value - noise) < k:
            raise ArithmeticError(f"eigenvalue {k} is not certified")
        values.append(value)
        vectors.append(vector)
    order = np.argsort(-np.array(values), kind="stable")
    return scale * np.array(values)[order], np.array(vectors).reshape(count, n)[order].T


def _fresh(start: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    """A unit vector apart from those found: ``start`` if enough of it is left, else the axis that they cover least."""
    left = start - sum(((u @ start) * u for u in found), np.zeros(len(start)))
    if np.linalg.norm(left) < 1e-3 * np.linalg.norm(start):
        start = np.zeros(len(start))
        start[int(np.argmin(sum((u * u for u in found), np.zeros(len(start)))))] = 1.0
    return _apart(start, found)


def _quotient(a: np.ndarray, shift: float, start: np.ndarray, found: list[np.ndarray], noise: float) -> tuple[float, np.ndarray, bool]:
    """Rayleigh quotient iteration from ``shift``: value, vector, and whether the residual is down to rounding."""
    v = _fresh(start, found)
    first = Inertia(a, shift)
    for _ in range(2):  # turn towards the eigenvector nearest to the shift
        v = _apart(first.solve(v), found)
    best = (math.inf, shift, v)
    for _ in range(_QUOTIENT_STEPS):
        value = float(v @ a @ v)
        residual = float(np.linalg.norm(a @ v - value * v))
        if residual >= best[0]:
            break
        best = (residual, value, v)
        v = _apart(Inertia(a, value).solve(v), found)
    return best[1], best[2], best[0] <= noise
