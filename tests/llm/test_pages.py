"""Names of classes and attributes, cuts over whole pages, odd markup and tables of pages."""

import itertools
import random

import pytest

from gridweave.llm import html_text

PARTS = "<h1>The old mill</h1><p>The mill stood by the river for two hundred years.</p><p>It was torn down last spring.</p><p>Nothing is left of it now.</p>"
TEXT = "The old mill\nThe mill stood by the river for two hundred years.\nIt was torn down last spring.\nNothing is left of it now."


@pytest.mark.parametrize(
    "page",
    [
        '<article title="The hidden valley">%s</article>',
        '<article data-hidden="false">%s</article>',
        '<article class="post comment-open">%s</article>',
        "<article class='post tags-politics related'>%s</article>",
        '<div class="wrap right-sidebar"><article>%s</article></div>',
        '<div data-id="comment-1"><article>%s</article></div>',
        "<div id='main-content' class='has-side'>%s</div>",
        "<div>%s</div>",
        "<article aria-label='A story of comments and ads'>%s</article>",
        '<div data-style="display:none">%s</div>',
    ],
)
def test_names_that_say_nothing_lose_nothing(page):
    assert html_text.main_text(page % PARTS) == TEXT


@pytest.mark.parametrize(
    "out",
    [
        '<div class="sidebar"><p>Read more stories about mills and rivers. They are long.</p></div>',
        '<div class="site-footer"><p>This site belongs to nobody. All of it.</p></div>',
        '<div id="comments"><article><p>I lived there as a child. It was cold.</p></article></div>',
        '<article class="comment"><p>I lived there as a child. It was cold.</p></article>',
        '<div id="comment-17"><p>I lived there as a child. It was cold.</p></div>',
        '<div class="cookie-notice"><p>We use cookies to make all of this better. Agree.</p></div>',
        '<section role="navigation"><p>Home is where the long menu is. Always.</p></section>',
        '<p hidden>You cannot see this text. It is hidden here.</p>',
        '<div style="display: none"><p>You cannot see this text. It is hidden here.</p></div>',
        "<form><p>Write your name into this field. Then send it.</p></form>",
        "<aside><p>By the way, rivers flow downhill. Most do.</p></aside>",
        '<div class="ad"><p>Buy a new mill today. It is cheap and good.</p></div>',
    ],
)
def test_boilerplate_goes(out):
    assert html_text.main_text(f"{out}<article>{PARTS}</article>{out}") == TEXT
    assert html_text.main_text(f"<div><article>{PARTS}</article>{out}</div>") == TEXT


def test_random_names():
    """Attributes and classes drawn at random, none of which is one of the known words."""
    r = random.Random(4)
    letters = "bcdfgklmnprstvz"
    known = html_text._BAD | html_text._COMMENT | html_text._GOOD | html_text._BESIDE
    for _ in range(200):
        def word():
            while True:
                w = "".join(r.choice(letters) for _ in range(r.randrange(2, 8)))
                if w not in known:
                    return w

        attrs = []
        for _ in range(r.randrange(4)):
            name = r.choice(["class", "id", "data-hidden", "data-ad", word(), f"{word()}-hidden", f"x-class-{word()}"])
            # A known word beside an unknown one says nothing.
            value = " ".join(f"{word()}-{r.choice(['ad', 'menu', 'comment', word()])}" for _ in range(r.randrange(1, 3)))
            attrs.append(r.choice([f'{name}="{value}"', f"{name}='{value}'", f"{name} = \"{value}\""]))
        tag = r.choice(["article", "main", "div", "section"])
        assert html_text.main_text(f"<{tag} {' '.join(attrs)}>{PARTS}</{tag}>") == TEXT, attrs


def _cost(unary, edges, ok):
    return sum(max(0, -u) if yes else max(0, u) for u, yes in zip(unary, ok)) + sum(w for a, b, w in edges if ok[a] != ok[b])


def test_labels_are_a_least_cut_of_the_page():
    r = random.Random(8)
    parts = [
        "<p>Short.</p>", "<p>A longer sentence that has quite a few words in it.</p>", "<li><a href=x>link</a></li>", "<li>point</li>", "<div>text of a div</div>",
        "<h2>Heading</h2>", "<nav><a href=y>home</a></nav>", "<div class=ad>Buy it.</div>", "<article><p>Inside.</p>", "</article>", "<div>", "</div>", "<section class=content>", "</section>",
    ]
    moved = 0
    for _ in range(150):
        found, up = html_text.parse("".join(r.choice(parts) for _ in range(14)))
        if not 0 < len(found) <= 11:
            continue
        unary = [html_text._unary(b, any(x.inside for x in found)) for b in found]
        edges = html_text._edges(found, up)
        got = html_text.labels(found, up)
        least = min(_cost(unary, edges, ok) for ok in itertools.product([False, True], repeat=len(found)))
        assert _cost(unary, edges, got) == pytest.approx(least, abs=1e-6)
        moved += any(ok != (u > 0) for ok, u in zip(got, unary))
    assert moved > 30  # neighbors change what blocks would be on their own


def test_deep_pages():
    page = "<div>" * 3000 + "".join(f"<p>Sentence number {k} of a page.</p></div>" for k in range(3000))
    assert html_text.main_text(page).count("\n") == 2999


def test_lists_of_short_items_stay_with_their_text():
    page = "<div><p>The mill made many kinds of flour over the years.</p><ul><li>one</li><li>two</li><li>three</li></ul><p>All of them were sold in town.</p></div>"
    assert html_text.main_text(page).split("\n")[1:4] == ["one", "two", "three"]


def test_tables_of_pages(spark):
    rows = [(1, "u", f"<article>{PARTS}</article>", "t", 7), (1, "u", f"<article>{PARTS}</article>", "t", 7), (None, None, "", None, None), (3, "v", None, "x", 1), (4, "w", "<nav>menu</nav>", "", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in html_text.extract(df).collect())
    assert got == [(0, "", 0), (1, TEXT, len(TEXT)), (1, TEXT, len(TEXT)), (3, "", 0), (4, "", 0)]
    assert html_text.extract(df.limit(0)).count() == 0
