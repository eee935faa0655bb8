"""Hierarchical packing of token sequences into windows of several sizes.

Documents longer than the longest window give whole windows; the rest of each document is
routed to the smallest tier that holds it.  Windows are opened tier by tier, longest first, by
the longest waiting piece; their gaps are filled by the longest pieces of the tiers that fit,
and the last of a gap by a cut.  Every task packs what it reads, so nothing is shuffled.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame

from gridweave.llm import bpe
from gridweave.llm.common import Columns, id_text, map_columns

WINDOW = 1024
# Windows of one step group hold this many tokens together.
GROUP_TOKENS = 8 * WINDOW

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "window long, step_group long, ids array<int>"
)


class _Packer:
    """Pieces wait in one list by length; whoever opens a window decides its tier."""

    def __init__(self, window: int, smallest: int, group_tokens: int, first_id: int):
        self.tiers, self.group_tokens = powers(window), group_tokens
        self.routes = [t for t in self.tiers if t >= smallest]
        self.next_id = self.first_id = first_id
        self.windows = dict.fromkeys(self.tiers, 0)
        self.waiting: list[tuple[int, int]] = []  # (length, piece)
        self.pieces: dict[int, tuple] = {}  # piece -> (doc_id, start, its bytes, doc_tokens)
        self.made = self.tokens = 0
        self.out: Columns = self._empty()

    def _empty(self) -> Columns:
        return {c.split()[0]: [] for c in SCHEMA.split(", ")}

    def take(self) -> Columns:
        out, self.out = self.out, self._empty()
        return out

    def _wait(self, doc, start: int, ids: bytes, total: int) -> None:
        self.made += 1
        self.pieces[self.made] = (doc, start, ids, total)
        insort(self.waiting, (len(ids) // 4, self.made))
        self.tokens += len(ids) // 4

    def _pull(self, at: int) -> tuple:
        length, key = self.waiting.pop(at)
        self.tokens -= length
        return self.pieces.pop(key)

    def _emit(self, parts: list[tuple], window: int) -> None:
        per_group = max(1, self.group_tokens // window)
        tier = self.tiers.index(window)
        group = self.first_id + (self.windows[window] // per_group) * len(self.tiers) + tier
        self.windows[window] += 1
        o, offset = self.out, 0
        for doc, start, ids, total in parts:
            n = len(ids) // 4
            for name, v in zip(o, (doc, start, n, zlib.crc32(ids), total, self.next_id, offset, window, group, np.frombuffer(ids, "<i4")), strict=True):
                o[name].append(v)
            offset += n
        self.next_id += 1

    def add(self, doc, ids: bytes) -> None:
        top, total = self.tiers[-1], len(ids) // 4
        whole = total // top
        for k in range(whole):
            self._emit([(doc, k * top, ids[4 * k * top : 4 * (k + 1) * top], total)], top)
        if total % top:
            self._wait(doc, whole * top, ids[4 * whole * top :], total)

    def _fill(self, window: int) -> None:
        """One full window, opened by the longest piece that is not above it."""
        at = bisect_right(self.waiting, (window, self.made)) - 1
        if at < 0:  # all are longer: cut one
            at = 0
        parts, gap = [], window
        while gap:
            doc, start, ids, total = self._pull(at)
            use = min(gap, len(ids) // 4)
            parts.append((doc, start, ids[: 4 * use], total))
            if 4 * use < len(ids):
                self._wait(doc, start + use, ids[4 * use :], total)
            gap -= use
            # The longest piece that fits, else the shortest one is cut.
            at = max(0, bisect_right(self.waiting, (gap, self.made)) - 1)
        self._emit(parts, window)

    def settle(self) -> None:
        """Full windows while enough tokens wait."""
        while self.tokens >= self.tiers[-1]:
            longest = self.waiting[-1][0]
            self._fill(next(t for t in self.routes if t >= longest))

    def finish(self) -> None:
        """The last tokens of the task, fewer than a window: full windows of falling powers of two."""
        self.settle()
        for t in reversed(self.tiers):
            while self.tokens >= t:
                self._fill(t)


def powers(window: int) -> list[int]:
    """Powers of two below ``window``, and ``window``."""
    out, t = [], 1
    while t < window:
        out.append(t)
        t *= 2
    return [*out, window]


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_path: str | None = None,
    window: int = WINDOW,
    smallest: int = 128,
    group_tokens: int = GROUP_TOKENS,
    end_id: int = 0,
) -> DataFrame:
    """One row per piece of a document: its ids, where it starts there and where it lies in its window.

    Each id of each row of ``docs`` lies in exactly one piece; a null or empty text is the end
    id alone.  A row with a null id is packed with a null ``doc_id``; repeated rows are packed
    each for itself; an empty table gives no piece.  ``sequence_id`` and ``step_group`` hold the
    partition in their upper bits.  Tiers are the powers of two
    from ``smallest`` to ``window``; the last tokens of a task, fewer than a window, go to windows of
    falling powers of two, so no window is padded.  A step group has windows of one size and
    ``group_tokens`` tokens, but for the last of a task.  A task holds one Arrow batch of ids.
    """
    path = tokenizer_path or bpe.default_path()
    end = int(end_id).to_bytes(4, "little")

    def make():
        store = bpe.lookups(path)
        packer = _Packer(window, smallest, group_tokens, TaskContext.get().partitionId() << 33)

        def work(given: Columns | None) -> Iterator[Columns]:
            if given is None:
                packer.finish()
                yield packer.take()
                return
            at = 0
            while at < len(given["text"]):
                upto, chars = at, 0
                while upto < len(given["text"]) and chars < 1 << 22:
                    chars += len(given["text"][upto])
                    upto += 1
                texts = given["text"][at:upto]
                for doc, ids in zip(given["doc_id"][at:upto], bpe.encode_all(texts, store), strict=True):
                    packer.add(doc, ids + end)
                packer.settle()
                yield packer.take()
                at = upto

        return work

    return map_columns(id_text(docs, id_col, text_col), make, SCHEMA)
