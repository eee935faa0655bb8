"""Standard normal draws as a pure function of their key.

Each draw depends only on (seed, key columns, position), never on partitioning, task
order or retries.  One md5 gives four 32-bit uniforms and so two Box-Muller pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gaussian_array(width: int, seed: int, *keys: str) -> Column:
    """Array of ``width`` independent standard normals for the row with these key expressions.

    Built as one SQL expression: a sketch has hundreds of terms, and one parsed text is far
    cheaper to set up than as many column objects.
    """
    if width < 0:
        raise ValueError(f"width must be >= 0, got {width}")
    if not width:
        return F.expr("cast(array() as array<double>)")
    text = ", ".join(f"cast({k} as string)" for k in keys)
    out = []
    for q in range((width + 3) // 4):
        digest = f"md5(concat_ws(':', '{seed}', {text}, '{q}'))"
        u = [
            f"((cast(conv(substring({digest}, {8 * w + 1}, 8), 16, 10) as double) + 0.5D) / 4294967296.0D)"
            for w in range(4)
        ]
        for w in (0, 2):
            radius, angle = f"sqrt(-2.0D * ln({u[w]}))", f"({2.0 * math.pi!r}D * {u[w + 1]})"
            out += [f"{radius} * cos({angle})", f"{radius} * sin({angle})"]
    return F.expr(f"array({', '.join(out[:width])})")


# The constants of MD5 (RFC 1321).
_TURNS = np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], np.uint32)
_SINES = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint32)
_BEGIN = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], np.uint32)
# Longest text that fits one MD5 block.
_ONE_BLOCK = 55


def _md5(texts: pa.BinaryArray) -> np.ndarray:
    """MD5 of each short text as four big-endian numbers, all texts in step."""
    n, offsets = len(texts), np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    size = np.diff(offsets)
    if n == 0 or size.max() > _ONE_BLOCK:
        return np.frombuffer(b"".join(hashlib.md5(t, usedforsecurity=False).digest() for t in texts.to_pylist()), ">u4").reshape(-1, 4)
    block, row = np.zeros((n, 64), np.uint8), np.repeat(np.arange(n), size)
    block[row, np.arange(size.sum()) - np.repeat(offsets[:-1] - offsets[0], size)] = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    block[np.arange(n), size] = 0x80
    block[:, 56:58] = (8 * size).astype("<u2").view(np.uint8).reshape(n, 2)
    words = np.ascontiguousarray(block.view("<u4").T)
    a, b, c, d = (np.full(n, x) for x in _BEGIN)
    for i in range(64):
        kind = i // 16
        if kind == 0:
            f, at = d ^ (b & (c ^ d)), i
        elif kind == 1:
            f, at = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif kind == 2:
            f, at = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, at = c ^ (b | ~d), 7 * i % 16
        f = f + a + _SINES[i] + words[at]
        turn = _TURNS[kind, i % 4]
        a, d, c, b = d, c, b, b + ((f << turn) | (f >> (np.uint32(32) - turn)))
    return (np.stack([a, b, c, d], axis=1) + _BEGIN).astype("<u4").view(np.uint8).view(">u4")


def normals(width: int, seed: int, *keys: pa.Array) -> np.ndarray:
    """The draws of ``gaussian_array`` for a batch of whole-number keys, one row each; equal keys of the batch are drawn once.

    As an SQL expression, most of a draw's time goes into turning digits of the md5 into numbers.
    """
    text = pc.binary_join_element_wise(pa.scalar(str(seed)), *[pc.cast(k, pa.string()) for k in keys], ":", null_handling="skip")
    text = (text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text).dictionary_encode()
    raw = [_md5(pc.binary_join_element_wise(text.dictionary, pa.scalar(str(q)), ":").cast(pa.binary())) for q in range((width + 3) // 4)]
    u = (np.concatenate(raw, axis=1).reshape(len(text.dictionary), -1, 2) + 0.5) / 4294967296.0
    radius, angle = np.sqrt(-2.0 * np.log(u[:, :, 0])), 2.0 * math.pi * u[:, :, 1]
    drawn = np.stack([radius * np.cos(angle), radius * np.sin(angle)], axis=2).reshape(len(u), -1)[:, :width]
    return drawn[text.indices.to_numpy()]


def with_normals(df: DataFrame, width: int, seed: int, keys: Sequence[str], out: str) -> DataFrame:
    """``df`` with ``out``, the draws of ``gaussian_array`` for whole-number columns ``keys``, made batch by batch."""
    if width < 0:
        raise ValueError(f"width must be >= 0, got {width}")
    if not width:
        return df.withColumn(out, gaussian_array(0, seed))
    names = [c for c in df.columns if c != out]
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                drawn = normals(width, seed, *[batch.column(c) for c in keys])
                made = pa.ListArray.from_arrays(pa.array(np.arange(len(drawn) + 1, dtype=np.int32) * width), pa.array(drawn.ravel()))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], made], [*names, out])

    return df.mapInArrow(run, ", ".join([*[f"`{c}` {fields[c]}" for c in names], f"`{out}` array<double>"]))


def sketch_width(k: int, p: int = 0) -> int:
    """Width ``k + p`` of a sketch with target rank ``k`` and oversampling ``p``."""
    if k < 0 or p < 0:
        raise ValueError(f"k and p must be >= 0, got k={k}, p={p}")
    return k + p
