"""Byte-level BPE ids of whole texts, by the tokenizers library, with the work shared between equal words.

The pre-tokenizer never joins text across the start of a run ``[ ]?non-space+``, so ids of such a
segment do not depend on its surroundings and are looked up once per worker.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np

from gridweave.llm.common import worker_store

# The white space of the pre-tokenizer.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SEGMENT = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
WORD = re.compile(f"[^{_WS}]")
_UNIT = re.compile(f" ?[^{_WS}]+")
_RARE = re.compile("[\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SLICE = 1 << 20
# Entries of a worker's dictionary; past them it starts anew.
MOST_CACHED = 1_000_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _packed(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    raw = ids.tobytes()
    return [raw[a:b] for a, b in zip((4 * starts).tolist(), (4 * ends).tolist(), strict=True)]


def _sizes(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[int]:
    return (ends - starts).tolist()


class _Lookup(dict):
    """Segment -> value, encoded on first sight.  ``cut`` turns ids and the bounds of each segment in them into values; ``lead`` goes before each key."""

    def __init__(self, tokenizer, cut: Callable[[np.ndarray, np.ndarray, np.ndarray], list], lead: str = ""):
        super().__init__()
        self.tokenizer, self.cut, self.lead = tokenizer, cut, lead
        (self.line_id,) = tokenizer.encode("\n", add_special_tokens=False).ids

    def __missing__(self, key: str):
        if len(self) >= MOST_CACHED:
            self.clear()
        ids = np.asarray(self.tokenizer.encode(self.lead + key, add_special_tokens=False).ids, "<u4")
        (self[key],) = value = self.cut(ids, np.array([0]), np.array([len(ids)]))
        return value[0]

    def learn(self, keys: set[str]) -> None:
        """Encode unseen keys many at a time: a line feed between words is a token of its own that no word holds."""
        # A set minus a key view would walk all the keys of the dictionary.
        new = [k for k in keys if k not in self]
        if len(self) + len(new) >= MOST_CACHED:
            self.clear()
            new = list(keys)
        new = [k for k in new if _UNIT.fullmatch(k)]
        groups = [new[i : i + 512] for i in range(0, len(new), 512)]
        between = "\n" + self.lead
        for keys_, done in zip(groups, self.tokenizer.encode_batch_fast([self.lead + between.join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.asarray(done.ids, "<u4")
            ends = np.append(np.flatnonzero(ids == self.line_id), len(ids))
            self.update(zip(keys_, self.cut(ids, np.append(0, ends[:-1] + 1), ends), strict=True))


def _tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True  # their strings in a text are ordinary text
    return found


def lookups(path: str) -> dict:
    """The worker's dictionaries for one vocabulary file: packed ids of a segment, with and without a leading space, and counts."""
    store = worker_store(f"bpe {path}")
    if not store:
        t = _tokenizer(path)
        store.update(plain=_Lookup(t, _packed), spaced=_Lookup(t, _packed, " "), count=_Lookup(t, _sizes))
    return store


def _slices(text: str) -> Iterator[str]:
    """Parts of a long text that begin at a space between two words, so that encoding them apart changes nothing."""
    at = 0
    while len(text) - at > 2 * _SLICE:
        cut = text.find(" ", at + _SLICE)
        while 0 < cut < len(text) - 1 and (text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut = text.find(" ", cut + 1)
        if not 0 < cut < len(text) - 1:
            break
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def _lines(part: str) -> list[list[str]] | None:
    """Words by line if every white space of ``part`` is one character between two words; else None."""
    if "  " in part or "\n " in part or " \n" in part or "\n\n" in part or "\t" in part or part[-1:] == " " or _RARE.search(part):
        return None
    return [line.split(" ") for line in part.split("\n")]


def encode(text: str, store: dict) -> bytes:
    """Ids of ``text`` as little-endian unsigned 32-bit numbers, exactly as the tokenizer gives them."""
    return encode_all([text], store)[0]


def encode_all(texts: list[str], store: dict) -> list[bytes]:
    """``encode`` of several texts; their unseen words are encoded together."""
    plain, spaced = store["plain"], store["spaced"]
    parts = [[(p, _lines(p)) for p in _slices(t)] for t in texts]
    first, rest = set(), set()
    for lines in (x for p in parts for _, x in p if x):
        for words in lines:
            first.add(words[0])
            rest.update(words[1:])
    plain.learn(first)
    spaced.learn(rest)
    del first, rest
    line_feed = plain["\n"]
    out = []
    for text in parts:
        raw: list[bytes] = []
        for part, lines in text:
            if lines is None:
                raw += map(plain.__getitem__, SEGMENT.findall(part))
                continue
            if part[0:1] == " ":  # a slice begins at a space
                lines[0] = lines[0][1:]
                raw.append(spaced[lines[0].pop(0)])
                raw += map(spaced.__getitem__, lines[0])
                lines = lines[1:]
                if lines:
                    raw.append(line_feed)
            for k, (head, *tail) in enumerate(lines):
                if k:
                    raw.append(line_feed)
                if head:
                    raw.append(plain[head])
                raw += map(spaced.__getitem__, tail)
        out.append(b"".join(raw))
    return out
