"""Main text of web pages: blocks are labelled content or boilerplate by a minimum cut.

A linear classifier gives each block a cost for either label (the terminal capacities); blocks that
follow each other or stand near each other in the document tree are tied by smoothness edges.
"""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm import mincut
from gridweave.llm.common import Columns, map_columns, per_row

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]+|<",
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s/>=\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")

# HTML elements by their role.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics annotation annotation-xml".split()
)
# Elements without text of the page, if they are closed, and those whose text is a boilerplate block of its own.
_DROPPED = frozenset("template noscript svg iframe".split())
_CONTROLS = frozenset("button select textarea object canvas".split())
_PAIRED = _DROPPED | _CONTROLS | {"title"}
_IN_HEAD = frozenset("html head base basefont bgsound link meta title script style template noscript noframes".split())
_OUTSIDE = frozenset("nav footer aside form menu dialog".split())
_INSIDE = frozenset("article main".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_CLOSED_BY = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
# Words that class, id, role and label names of boilerplate, of reader comments and of content are made of, and
# words that may stand beside them.
_BAD = frozenset(
    "nav navbar navigation menu footer foot masthead topbar header sidebar side rail ad ads advert adverts advertisement adsense banner promo promoted sponsor sponsored "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup share sharing social related recommended "
    "breadcrumb breadcrumbs widget login copyright pager pagination toolbar skip search complementary contentinfo teaser tags dialog".split()
)
_COMMENT = frozenset("comment comments commentlist reply replies respond disqus".split())
_GOOD = frozenset("article content main post entry story body text articlebody".split())
_BESIDE = frozenset(
    "site page global top bottom left right upper lower box boxes list lists section area wrap wrapper container inner outer item items block bar panel primary secondary "
    "links link id col column row group unit slot zone holder form thread".split()
)
_NAME = re.compile(r"[^\W\d_]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

# Weights of the block classifier, as log odds of content.
_W = {"open": 2.0, "outside": -8.0, "control": -8.0, "header": -5.0, "bad": -6.0, "hidden": -9.0, "inside": 3.0, "good": 2.0, "p": 1.0, "heading": 0.6, "li": -0.5, "other": -0.3, "words": 0.6, "bias": -1.4, "links": -4.0, "sentence": 0.6, "rights": -2.0}
# The most that an edge weighs, between blocks of one element; it falls with their distance in the tree.
_ADJACENT, _SIBLING = 2.0, 1.0
_RIGHTS = re.compile(r"©|\(c\)\s*\d{4}|all rights reserved", re.I)
_SENTENCE = re.compile(r"[.!?…。]")


@dataclass
class Block:
    text: str
    tag: str
    node: int  # the innermost open element that is no inline one; 0 outside of all
    cue: float  # from the elements around
    linked: float  # share of its characters in links
    inside: bool  # within an article or main element


def _named(value: str) -> str:
    """What a class or id says: ``comment``, ``bad``, ``good`` or nothing.

    A token counts as a whole: all the words that it is made of must be known, so that a name which merely holds
    a word of these, like has-side or tags-politics, says nothing.
    """
    found = set()
    for token in value.lower().split():
        words = set(_NAME.findall(token))
        if words and words <= _BAD | _COMMENT | _GOOD | _BESIDE:
            found.add("comment" if words & _COMMENT else "bad" if words & _BAD else "good" if words & _GOOD else "")
    return next((k for k in ("comment", "bad", "good") if k in found), "")


def _cue(tag: str, attrs: str, hard: float, soft: float, inside: bool) -> tuple[float, float]:
    """What an element, with those around it, says of all it holds: a part that stands and one that an inner article replaces."""
    own = 0.0
    if tag in _OUTSIDE:
        hard += _W["outside"]
    elif tag in _CONTROLS:
        hard += _W["control"]
    elif tag == "header" and not inside:
        hard += _W["header"]
    comment = False
    if attrs.strip("/ \t\n"):
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), a or b or c
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _HIDDEN.search(value)):
                hard += _W["hidden"]
            elif name in ("class", "id", "role", "itemprop", "aria-label") and tag not in ("body", "html"):
                said = _named("-".join(value.split()) if name == "aria-label" else value)
                comment = comment or said == "comment"
                # Class names of an article are its topics and layout, unless they call it a comment.
                if said == "bad" and tag not in _INSIDE:
                    own += _W["bad"]
                elif said == "good" and name != "aria-label":
                    own += _W["good"]
    if comment:
        hard += _W["bad"]
    elif tag in _INSIDE:
        return hard, _W["inside"] + own
    return hard, soft + own


def _ends(tokens: list[re.Match]) -> dict[int, int]:
    """Places of the end tags of the elements in ``_PAIRED``, by those of their start tags; unclosed ones are left out."""
    open_: dict[str, list[int]] = {}
    out = {}
    for i, m in enumerate(tokens):
        tag = m[3] and m[3].lower()
        if tag in _PAIRED:
            if not m[2]:
                open_.setdefault(tag, []).append(i)
            elif open_.get(tag):
                out[open_[tag].pop()] = i
    return out


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order; see ``parse``."""
    return parse(page)[0]


def parse(page: str) -> tuple[list[Block], list[int]]:
    """The text blocks of a page in order, and the element around each element, by number; with character references decoded and white space as single spaces.

    Only script, style and comments run to the end of the page if they are not closed.  A head ends at its end tag or
    before whatever cannot stand in it.  Closed template, noscript, svg and iframe are left out; the text of closed
    buttons and the like is a block of its own, beside that around it; unclosed ones say nothing of what follows.
    """
    out: list[Block] = []
    stack: list[tuple[str, int, float, float, bool]] = []  # tag, number, both cues of it and all around, within an article
    made, links = 0, 0
    up = [0]  # the element around each element; inline ones are passed over
    parts: list[str] = []
    linked = total = 0

    def flush() -> None:
        nonlocal linked, total
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                tag, node = next(((t, k) for t, k, *_ in reversed(stack) if t not in _INLINE), ("", 0))
                cue, inside = (stack[-1][2] + stack[-1][3], stack[-1][4]) if stack else (0.0, False)
                out.append(Block(text, tag, node, cue, linked / max(1, total), inside))
            parts.clear()
        linked = total = 0

    def pop_to(at: int) -> None:
        nonlocal links
        while len(stack) > at:
            links -= stack.pop()[0] == "a"

    def push(tag: str, attrs: str) -> None:
        nonlocal made
        _, around, hard, soft, inside = stack[-1] if stack else ("", 0, 0.0, 0.0, False)
        if stack and stack[-1][0] in _INLINE:
            around = up[around]
        made += 1
        up.append(around)
        stack.append((tag, made, *_cue(tag, attrs, hard, soft, inside), inside or tag in _INSIDE))

    tokens = list(_TOKEN.finditer(page))
    ends = _ends(tokens)
    aside: list[tuple[int, int, list[str], int, int]] = []  # end of a control, its number, the text around it so far and its sizes
    head, i = True, -1  # a head needs no tag
    while i + 1 < len(tokens) or aside:
        i += 1
        if aside and i >= aside[-1][0]:
            flush()
            end, number, parts[:], linked, total = aside.pop()
            pop_to(next((k for k in range(len(stack)) if stack[k][1] == number), len(stack)))
            i -= i > end
            continue
        m = tokens[i]
        tag = m[3]
        if tag is None:
            if m[1]:
                flush()
            elif m[0][0] != "<" or m[0] == "<":
                head = head and m[0].isspace()
                parts.append(m[0])
                size = len(m[0])
                total += size
                if links:
                    linked += size
            continue
        tag = tag.lower()
        if m[2]:
            head = head and tag not in ("head", "body", "html", "br")
        elif tag == "head":
            head = True
            continue
        else:
            head = head and tag in _IN_HEAD
            if i in ends and (tag in _DROPPED or tag == "title" and head):
                i = ends[i]
                if tag != "svg":
                    flush()
                continue
            if tag in _CONTROLS:
                if i not in ends:
                    continue
                push(tag, m[4])
                aside.append((ends[i], made, parts[:], linked, total))
                parts.clear()
                linked = total = 0
                if tag == "textarea":  # plain text up to its end
                    parts.append(page[m.end() : tokens[ends[i]].start()])
                    total = len(parts[0])
                    i = ends[i] - 1
                continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in _INLINE:
            flush()
        if m[2]:
            for at in range(len(stack) - 1, -1, -1):
                if stack[at][0] == tag:
                    pop_to(at)
                    break
                if tag in _INLINE and stack[at][0] not in _INLINE:
                    break
            continue
        if tag in _ENDS_P:
            for at in range(len(stack) - 1, -1, -1):
                if stack[at][0] == "p":
                    pop_to(at)
                    break
                if stack[at][0] not in _INLINE:
                    break
        if tag in _CLOSED_BY:
            for at in range(len(stack) - 1, -1, -1):
                if stack[at][0] == tag or {stack[at][0], tag} == {"dt", "dd"} or {stack[at][0], tag} == {"td", "th"}:
                    pop_to(at)
                    break
                if stack[at][0] in _CLOSED_BY[tag]:
                    break
        if tag in _VOID or m[4].endswith("/") and tag in ("path", "circle"):
            continue
        push(tag, m[4])
        links += tag == "a"
    flush()
    return out, up


def _unary(b: Block, explicit: bool) -> float:
    """Log odds of content; ``explicit`` says that the page has an article or main element."""
    words = b.text.count(" ") + 1
    kind = "p" if b.tag in ("p", "blockquote", "pre") else "heading" if b.tag in _HEADINGS else "li" if b.tag in ("li", "dt", "dd", "td", "th") else "other"
    u = _W["bias"] + _W[kind] + _W["words"] * math.log1p(words) + _W["links"] * b.linked + max(-12.0, min(5.0, b.cue))
    if not explicit and b.cue >= 0:
        u += _W["open"]
    if _SENTENCE.search(b.text):
        u += _W["sentence"]
    if _RIGHTS.search(b.text):
        u += _W["rights"]
    return u


def _edges(found: list[Block], up: list[int]) -> list[tuple[int, int, float]]:
    """Between blocks that follow each other, and between a block and the last one that stands in the same element's child."""
    deep = [0] * len(up)
    for k in range(1, len(up)):
        deep[k] = deep[up[k]] + 1
    edges = []
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            p, q, steps = found[i - 1].node, b.node, 0
            while p != q:
                if deep[p] < deep[q]:
                    p, q = q, p
                p, steps = up[p], steps + 1
            edges.append((i - 1, i, 2 * _ADJACENT / (2 + steps)))
        parent = up[b.node]
        if last.get(parent, i - 1) < i - 1:
            edges.append((last[parent], i, _SIBLING))
        last[parent] = i
    return edges


def labels(found: list[Block], up: list[int]) -> list[bool]:
    """Which blocks are content."""
    explicit = any(b.inside for b in found)
    return mincut.split([_unary(b, explicit) for b in found], _edges(found, up))


def main_text(page: str) -> str:
    found, up = parse(page)
    return "\n".join(b.text for b, ok in zip(found, labels(found, up), strict=True) if ok)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: ``page_id, url, text, n_chars, n_blocks, n_content``.

    A null or empty page, or one without content, gives an empty text.  Pages are read whole and broken
    markup is taken as far as it goes.  Null ids and urls stay, repeated rows are extracted each, an
    empty table gives an empty one.
    """

    def rows(given: Columns) -> Columns:
        out: Columns = {k: [] for k in ("page_id", "url", "text", "n_chars", "n_blocks", "n_content")}
        for page, url, source in zip(given["page_id"], given["url"], given["html"], strict=True):
            found, up = parse(source)
            ok = labels(found, up)
            text = "\n".join(b.text for b, yes in zip(found, ok, strict=True) if yes)
            for k, v in zip(out, (page, url, text, len(text), len(found), sum(ok)), strict=True):
                out[k].append(v)
        return out

    given = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return map_columns(given, per_row(rows), "page_id long, url string, text string, n_chars long, n_blocks long, n_content long")
