"""Pages without an article, names of many forms, and what decides a block."""

import pytest

from tidewick.llm import html_text

TREE = html_text.train()
PROSE = "<p>" + "word " * 60 + "</p>"
WORDS = " ".join(["word"] * 60)


def text(page):
    return html_text.main_text(page, TREE)


def links(n, words=1):
    return "".join(f'<a href="/{i}">{"link " * words}</a> ' for i in range(n))


def test_pages_without_an_article():
    assert text(f"<body><div>{links(12, 6)}</div>{PROSE}") == WORDS
    assert text(f"<body>{PROSE}<p>The end.</p>") == f"{WORDS} The end."
    assert text("<body><h1>A title</h1><p>One paragraph of ten words that is all of it.</p>") == "A title One paragraph of ten words that is all of it."
    assert text("<body><p>Short.</p>") == "Short." and text("plain text") == "plain text"
    assert text(f"<body>{PROSE}<p>On.</p>{PROSE}<p>Off.</p><footer>end</footer>") == f"{WORDS} On. {WORDS} Off."
    assert text(f"<body><ul><li>{links(1)}<li>{links(1)}</ul><p>A first line.</p>{PROSE}") == f"A first line. {WORDS}"
    assert text(f"<body>{PROSE}<h3>More to read</h3><ul><li>{links(1)}<li>{links(1)}</ul>") == WORDS
    assert text(f"<body>{PROSE}<p>See <a href=x>this</a>.</p><p>{links(9, 2)}</p>") == f"{WORDS} See this."


@pytest.mark.parametrize(
    "name",
    ["post-comments", "ad-300x250", "ad-banner-2", "div-gpt-ad-1", "post-ad", "cookie-law-info", "newsletter-cta", "article-footer", "post-header", "site-footer", "reader_comments", "searchForm", "AdSlot", "sidebar-right", "gdpr-notice", "top-ads-3"],
)
def test_boilerplate_names_inside_an_article(name):
    for inner in ("<p>Buy it now</p>", PROSE.replace("word", "other")):
        for mark in (f'class="{name}"', f"id={name}", f"class='x {name}'"):
            assert text(f"<article><h1>T</h1>{PROSE}<div {mark}>{inner}</div>{PROSE}</article>") == f"T {WORDS} {WORDS}", (name, mark)


@pytest.mark.parametrize("name", ["has-sidebar", "no_banner", "comment-on-the-text", "share-price", "related-work", "category-social", "content-with-sidebar", "adhesion", "navigate", "heading", "headers2", "form-of-life", "ad-hoc-networks"])
def test_names_of_the_subject_stay(name):
    assert text(f'<article>{PROSE}<div class="{name}"><p>Kept line.</p></div>{PROSE}</article>') == f"{WORDS} Kept line. {WORDS}"


def test_doubtful_names_go_by_words_and_links():
    wrap = lambda inner: f'<article>{PROSE}<div class="searchResults">{inner}</div>{PROSE}</article>'
    assert html_text.name_level("searchResults") == 1
    assert text(wrap(PROSE)) == f"{WORDS} {WORDS} {WORDS}" and text(wrap("<p>found</p>")) == f"{WORDS} found {WORDS}"
    assert text(wrap(f"<p>{links(5)}</p>")) == f"{WORDS} {WORDS}" and text(wrap(f"<ul><li>{links(1)}<li>{links(1)}</ul>")) == f"{WORDS} {WORDS}"


def test_a_name_around_the_main_part_is_excused():
    for name in ("right-sidebar", "searchResults", "header-page"):
        assert text(f'<body class="ads"><div class="{name}"><main>{PROSE}<div class="sidebar">x</div></main></div><div class="{name}">y</div>') == WORDS


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_pages_with_their_article_unmarked(spark, sf):
    """With <article> taken for <div>, blocks are told apart by words, links, neighbours and names; nearly every page gives the same text."""
    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").collect()
    right = decided = blocks = 0
    for r in pages:
        page = r.html.replace("<article", "<div").replace("</article", "</div")
        right += text(page) == text(r.html)
        rows = html_text.rows_of(html_text.blocks(page))
        plain = [x for x in rows if not x[7] and not x[8]]
        blocks += len(rows)
        decided += len(plain)  # neither an article nor a name says anything of these
    assert right >= 0.95 * len(pages) and decided > 0.3 * blocks


def test_every_feature_is_used():
    used = set()

    def walk(t):
        if not isinstance(t, int):
            used.add(t[0])
            walk(t[2])
            walk(t[3])

    walk(TREE)
    assert used >= {2, 4, 6, 7, 8} and used & {0, 1} and used & {3, 5}
