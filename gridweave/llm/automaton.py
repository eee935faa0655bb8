"""Byte-pair encoding by an automaton built from the merge list, gadget by gadget.

The automaton reads tokens: its states are the last token read, and an arc ``p -> q`` says that
``q`` may follow ``p``.  It starts with one token per byte and all arcs.  The gadget of a merge
``u v -> w`` cuts the arc ``u -> v``, gives ``w`` the arcs that left ``v``, and leads into ``w``
what leads into ``u``.  After the last gadget exactly the token sequences that the merges yield
are accepted, one per byte string, so encoding is a walk with no choice.

50,000 merges make up to 2.5 billion arcs.  They are not listed: a gadget is kept with its
time, and an arc is traced back through the gadgets that copied it (``MergeAutomaton.arc``).
For encoding, token arcs are compiled on first use into a table over (state, byte); a state
stands for all token starts that are still open and knows the last token of what was read.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm import bpe
from gridweave.llm.common import Columns, id_text, map_columns, per_row, worker_store

START = -1
# Keys of a table row beside its bytes.
OPEN, LAST = -1, -2
# Pre-splitting of segments of printable ASCII and Latin letters, which have no white space but a leading space.
_SIMPLE = re.compile(" ?[!-~À-ÖØ-öø-ɏ]+")
_SPLIT = re.compile("'(?:[stmd]|re|ve|ll)| ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+| ?[^ A-Za-z0-9À-ÖØ-öø-ɏ]+")
# Rows of the byte table that a worker keeps; past them it starts anew.
MOST_STATES = 120_000
# Words that a worker keeps twice over: those since the last change, and those before it.
MOST_WORDS = 180_000
# Characters of the texts that are encoded together.
TOGETHER = 1 << 22


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 as it is, the others from U+0100 on."""
    # The printable ranges of the byte-level alphabet.
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


class MergeAutomaton:
    """Token automaton of a merge list, and its byte table.

    ``labels[t]`` are the bytes of token ``t``; ``merges`` are pairs of tokens in order of rank.
    Every merge must make a token of its own, later than its parts.
    """

    def __init__(self, labels: dict[int, bytes], merges: Iterable[tuple[int, int]]):
        top = max(labels) + 1
        self.labels = labels
        self.size = [len(labels.get(t, b"")) for t in range(top)]
        self.left, self.right, self.born = [START] * top, [START] * top, [0] * top
        self.cut: dict[tuple[int, int], int] = {}
        of = {label: t for t, label in labels.items()}
        made = {t for t, label in labels.items() if len(label) == 1}
        if len(made) != 256:
            raise ValueError(f"the vocabulary must have one token per byte, found {len(made)}")
        self.live = set(made)
        for time, (u, v) in enumerate(merges, 1):
            w = of.get(labels[u] + labels[v])
            if w is None or w in made or u not in made or v not in made:
                raise ValueError(f"merge {time} does not make a new token of earlier ones")
            made.add(w)
            self._gadget(u, v, w, time)
        self.trie: list[dict[int, int]] = [{}]
        self.ends = [START]
        for t in sorted(self.live):
            at = 0
            for c in labels[t]:
                at = self.trie[at].setdefault(c, len(self.trie))
                if at == len(self.trie):
                    self.trie.append({})
                    self.ends.append(START)
            self.ends[at] = t
        self.forget()

    def _gadget(self, u: int, v: int, w: int, time: int) -> None:
        """Add one merge.  Where no arc leads from ``u`` to ``v`` any more, the merge never happens and ``w`` has no arc."""
        if u not in self.live or v not in self.live or not self.arc(u, v, time - 1):
            return
        self.left[w], self.right[w], self.born[w] = u, v, time
        self.cut[u, v] = time
        self.live.add(w)

    def arc(self, p: int, q: int, time: int | None = None) -> bool:
        """Whether ``q`` may follow ``p`` once the gadgets up to ``time`` (default: all) are in."""
        born, cut = self.born, self.cut
        time = len(self.born) if time is None else time
        while True:
            gone = cut.get((p, q))
            if gone is not None and gone <= time:
                return False
            at_p, at_q = born[p], born[q]
            if at_q > at_p:  # the arc into q was copied from the one into its left part
                q, time = self.left[q], at_q
            elif at_p > at_q:  # the arc out of p was copied from the one out of its right part
                p, time = self.right[p], at_p - 1
            elif not at_p:
                return True
            else:
                p, q, time = self.right[p], self.left[q], at_p - 1

    # -- byte table -----------------------------------------------------------
    def forget(self) -> None:
        """Start the byte table anew, with the state that has read nothing."""
        self.states: dict[tuple[int, ...], dict[int, object]] = {}
        self.known: dict[int, bool] = {}  # arcs traced back so far
        self.first = self._state((self._start(0, START),), START)

    @staticmethod
    def _start(node: int, before: int) -> int:
        """An open token start as one number: its trie node and the token before it."""
        return node << 20 | before + 1

    def _state(self, open_: tuple[int, ...], last: int) -> dict[int, object]:
        """A row of the table: byte -> row, with the open starts under OPEN and the last token under LAST."""
        key = (*open_, last)
        row = self.states.get(key)
        if row is None:
            row = self.states[key] = {OPEN: open_, LAST: last}
        return row

    def _step(self, row: dict[int, object], byte: int) -> dict[int, object]:
        """Compile one transition.  Of the tokens that end here, one alone has an arc from what was read before it."""
        live, last, trie, ends = [], START, self.trie, self.ends
        for packed in row[OPEN]:
            node = trie[packed >> 20].get(byte)
            if node is None:
                continue
            before = (packed & 0xFFFFF) - 1
            token = ends[node]
            if token != START and last == START:
                known = before == START or self.known.get(before << 20 | token)
                if known is None:
                    known = self.known[before << 20 | token] = self.arc(before, token)
                if known:
                    last = token
            if trie[node]:
                live.append(node << 20 | before + 1)
        live.append(self._start(0, last))
        row[byte] = to = self._state(tuple(live), last)
        return to

    def encode_word(self, word: bytes) -> list[int]:
        """Tokens of one pre-split word."""
        if len(self.states) > MOST_STATES:
            self.forget()
        row, path = self.first, []
        for byte in word:
            row = row.get(byte) or self._step(row, byte)
            path.append(row)
            if len(self.states) > 2 * MOST_STATES:  # a very long word: go on from its open starts
                self.forget()
                row = self._state(row[OPEN], row[LAST])
        out, at, size = [], len(word), self.size
        while at:
            token = path[at - 1][LAST]
            out.append(token)
            at -= size[token]
        out.reverse()
        return out

    def accepts(self, ids: list[int]) -> bool:
        """Whether the automaton reads this token sequence of one word."""
        return all(t in self.live for t in ids) and all(self.arc(p, q) for p, q in zip(ids, ids[1:]))


def _packed(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class _Words(dict):
    """Segment of a text -> its packed ids; a segment is pre-split and each new word walks the automaton.

    ``plain`` has segments as they are, the other one those behind a space, without it.
    """

    def __init__(self, automaton: MergeAutomaton, split, plain: _Words | None = None):
        super().__init__()
        self.automaton, self.split = automaton, split
        self.lead, self.plain = ("", self) if plain is None else (" ", plain)
        self.before: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= MOST_WORDS:
            self.before = dict(self)
            self.clear()
        out = self.before.get(key)
        if out is not None:
            self[key] = out
            return out
        text = self.lead + key
        words = _SPLIT.findall(text) if _SIMPLE.fullmatch(text) else [text[a:b] for _, (a, b) in self.split(text)]
        if len(words) == 1:
            out = _packed(self.automaton.encode_word(text.encode()))
        else:
            first = self[words[0][1:]] if self.lead and len(words[0]) > 1 else self.plain[words[0]]
            out = first + b"".join(map(self.plain.__getitem__, words[1:]))
        self[key] = out
        return out

    def learn(self, keys: set[str]) -> None:
        """Words are encoded when they are met."""


def _labels(spec: dict) -> dict[int, bytes]:
    letters = byte_letters()
    return {t: bytes(letters[c] for c in token) for token, t in spec["model"]["vocab"].items()}


def _arc_labels(path: str) -> list[bytes]:
    """The label of every token, those of added tokens too; kept by the worker."""
    store = worker_store(f"automaton {path}")
    if "arcs" not in store:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        arcs = _labels(spec) | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        store["arcs"] = [arcs.get(t, b"") for t in range(max(arcs) + 1)]
    return store["arcs"]


def _decoded(ids: bytes | None, arcs: list[bytes]) -> str:
    return b"".join(map(arcs.__getitem__, np.frombuffer(ids or b"", "<u4").tolist())).decode("utf-8", "replace")


def _compiled(path: str) -> dict:
    """The worker's automaton of one tokenizer file."""
    store = worker_store(f"automaton {path}")
    if "automaton" in store:
        return store
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, kind = spec["model"], spec["pre_tokenizer"]
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or spec["normalizer"] or kind["type"] != "ByteLevel" or kind["add_prefix_space"]:
        raise ValueError("only plain byte-level vocabularies without a normalizer are read")
    whole = spec["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in whole):
        raise ValueError("added tokens that take in their surroundings are not read")
    labels, ids = _labels(spec), model["vocab"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    automaton = MergeAutomaton(labels, [(ids[a], ids[b]) for a, b in pairs])
    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    plain_words = _Words(automaton, split)
    store.update(
        automaton=automaton,
        plain=plain_words,
        spaced=_Words(automaton, split, plain_words),
        whole={t["content"]: _packed([t["id"]]) for t in whole},
    )
    return store


def _parts(text: str, whole: dict[str, bytes]) -> list[str]:
    """``text`` cut at whole tokens, which stand at odd places; the leftmost is cut first, the longest of those."""
    out, at = [], 0
    while True:
        found = min(((p, -len(w), w) for w in whole if (p := text.find(w, at)) >= 0), default=None)
        if found is None:
            return [*out, text[at:]]
        out += [text[at : found[0]], found[2]]
        at = found[0] - found[1]


def _encode_all(texts: list[str], store: dict) -> list[bytes]:
    whole = store["whole"]
    cut = [_parts(t, whole) if any(w in t for w in whole) else None for t in texts]
    simple = iter(bpe.encode_all([t for t, c in zip(texts, cut, strict=True) if c is None], store))
    return [
        next(simple) if c is None else b"".join(whole[p] if k % 2 else bpe.encode_all([p], store)[0] for k, p in enumerate(c))
        for c in cut
    ]


def _rows_encoded(given: Columns, path: str) -> Columns:
    store, ids = _compiled(path), []
    at, texts = 0, given["text"]
    while at < len(texts):
        upto, chars = at, 0
        while upto < len(texts) and (upto == at or chars + len(texts[upto]) <= TOGETHER):
            chars += len(texts[upto])
            upto += 1
        ids += _encode_all(texts[at:upto], store)
        at = upto
    return {"doc_id": given["doc_id"], "n_tokens": [len(x) // 4 for x in ids], "ids": ids}


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids`` of every row; ``ids`` are packed as little-endian unsigned 32-bit numbers.

    Texts are encoded whole, as the tokenizer file says; the strings of its added tokens are those
    tokens.  A null or empty text has no id.  Null ids stay, repeated rows are encoded each for
    itself, an empty table gives an empty one, other columns play no part.
    """
    path = tokenizer_path or bpe.default_path()
    return map_columns(id_text(docs, id_col, text_col), per_row(lambda given: _rows_encoded(given, path)), "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, ids_col: str = "ids", tokenizer_path: str | None = None) -> DataFrame:
    """``doc_id, text``: the labels of the arcs in order, as UTF-8.

    Null ids give an empty text.  Bytes that are no UTF-8, which encoded texts never give, become U+FFFD.
    """
    path = tokenizer_path or bpe.default_path()

    def rows(given: Columns) -> Columns:
        arcs = _arc_labels(path)
        return {"doc_id": given["doc_id"], "text": [_decoded(x, arcs) for x in given["ids"]]}

    return map_columns(encoded.select("doc_id", F.col(ids_col).alias("ids")), per_row(rows), "doc_id long, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """``encode`` with ``decoded``, the text that the ids give again, beside it; both in one worker, so rows need no join."""
    path = tokenizer_path or bpe.default_path()

    def rows(given: Columns) -> Columns:
        out, arcs = _rows_encoded(given, path), _arc_labels(path)
        return out | {"decoded": [_decoded(x, arcs) for x in out["ids"]]}

    return map_columns(id_text(docs, id_col, text_col), per_row(rows), "doc_id long, n_tokens long, ids binary, decoded string")
