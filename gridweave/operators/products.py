"""Products of matrix tables with vectors, and matrix pieces.

A matrix is ``(i, j, v)``, a vector ``(j, x)``, a thick vector ``(j, xs ARRAY)``.  A missing
row of a vector is a zero.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.operators.treeqr import r_factors
from gridweave.skew import skew_join

# A vector up to this many doubles is copied to every executor instead of shuffling the matrix.
BROADCAST_DOUBLES = 4_000_000


def transpose(matrix: DataFrame) -> DataFrame:
    return matrix.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def join_vector(
    table: DataFrame,
    vec: DataFrame,
    key: str,
    spread: Sequence[str],
    vec_doubles: int | None = None,
    hot: DataFrame | None = None,
    wide: bool = False,
) -> DataFrame:
    """Attach a vector to table rows by ``key``: broadcast below a checked size, else a shuffled join.

    ``hot`` (from ``skew.hot_table``) salts hot keys of a matrix that is used many times.  A
    matrix used once is not read twice to look for them: vector keys are unique, so adaptive
    execution splits an oversized key's rows.  ``wide`` says that a row of the vector holds many
    numbers, which Spark's guess from file sizes does not know; it is then broadcast below a checked size only.
    """
    if vec_doubles is not None and vec_doubles <= BROADCAST_DOUBLES:
        return table.join(F.broadcast(vec), key)
    return skew_join(table, vec, [key], spread, hot, follows_input=wide)


def matvec(matrix: DataFrame, vec: DataFrame, vec_rows: int | None = None, hot: DataFrame | None = None, follows_input: bool = False) -> DataFrame:
    """``A x`` as ``(i, y)``; ``vec_rows`` is the vector's row count where the caller knows it.

    ``follows_input`` says that Spark's guess of the vector's size is too low, as its rows are expanded on the way.
    """
    met = join_vector(matrix, vec, "j", ["i"], vec_rows, hot, wide=follows_input)
    return met.groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("y"))


def rmatvec(matrix: DataFrame, vec: DataFrame, vec_rows: int | None = None, hot: DataFrame | None = None, follows_input: bool = False) -> DataFrame:
    """``A^T x`` for a vector ``(i, x)``, as ``(j, y)``."""
    return matvec(transpose(matrix), vec.withColumnRenamed("i", "j"), vec_rows, hot, follows_input).withColumnRenamed("i", "j")


def sum_arrays(width: int, term: Callable[[int], str]) -> Column:
    """Aggregate of ``width`` sums packed as an array; ``term(c)`` is the c-th summand in SQL."""
    return F.expr(f"array({', '.join(f'sum({term(c)})' for c in range(width))})")


def matvec_thick(matrix: DataFrame, vec: DataFrame, width: int, by: Sequence[str] = (), vec_rows: int | None = None) -> DataFrame:
    """``A X`` for a thick vector ``(j, xs)``, as ``(i, ys)``; ``by`` keeps extra vector columns apart."""
    met = join_vector(matrix, vec, "j", ["i"], None if vec_rows is None else vec_rows * width, wide=width > 1 or bool(by))
    return met.groupBy(*by, "i").agg(sum_arrays(width, lambda c: f"v * xs[{c}]").alias("ys"))


def rmatvec_thick(matrix: DataFrame, vec: DataFrame, width: int, by: Sequence[str] = (), vec_rows: int | None = None) -> DataFrame:
    """``A^T X`` for a thick vector ``(i, xs)``, as ``(j, ys)``."""
    flipped = matvec_thick(transpose(matrix), vec.withColumnRenamed("i", "j"), width, by, vec_rows)
    return flipped.withColumnRenamed("i", "j")


def with_zero_rows(vec: DataFrame, rows: DataFrame, key: str = "i", value: str = "y") -> DataFrame:
    """Fill rows listed in ``rows`` but absent from ``vec`` with zeros."""
    return rows.select(key).join(vec, key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(0.0)))


def difference(approx: DataFrame, matrix: DataFrame) -> DataFrame:
    """Entries of ``A_approx - A``: a signed union that the next product adds up."""
    return approx.select("i", "j", "v").unionByName(matrix.select("i", "j", (-F.col("v")).alias("v")))


def matrix_block(matrix: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """Entries whose row is in ``rows(i)`` and whose column is in ``cols(j)``."""
    return matrix.join(rows.select("i"), "i", "left_semi").join(cols.select("j"), "j", "left_semi").select("i", "j", "v")


def merged(entries: DataFrame) -> DataFrame:
    """Entries of one position added up; positions that cancel stay, as zeros."""
    return entries.groupBy("i", "j").agg(F.sum("v").alias("v"))


def block_spectrum(rows: DataFrame, block: str, values: str, width: int) -> DataFrame:
    """Singular values of each block of packed rows ``(block, values ARRAY of width)``: ``(block, n_rows, sigma)``.

    They are those of the block's R factor, from a tree of small factorizations; no block is
    ever gathered, and values far below the largest are resolved.
    """
    kind = rows.schema[block].dataType.simpleString()

    def spectrum(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                sigma = np.linalg.svd(np.stack(pdf["r"].to_numpy()).reshape(-1, width, width), compute_uv=False)
                yield pdf[[block, "n_rows"]].assign(sigma=list(sigma))

    return r_factors(rows, [block], values, width).mapInPandas(spectrum, f"`{block}` {kind}, n_rows long, sigma array<double>")
