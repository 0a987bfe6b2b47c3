"""Main text of web pages: flat text blocks and a small decision tree.

A page is cut into blocks at block-level tags. Each block gets its words, links and link density, words and density of its neighbours,
whether it stands in the page's article or main, what the names around it say, and whether it is a heading. A decision tree, trained on
the labelled table below, keeps or drops each block; kept blocks are joined in page order. Lists of links, labels between them and lines at the edge of a menu
go by words and density, where the page marks no article; inside an article they decide wherever a name is doubtful.

Boilerplate markup are tags and names (class, id, role) of the kinds that the contract lists. The words of a name are scored: words of those kinds speak for
it, the more so at its end, words of a place or a box say nothing, unknown ones speak against it a little and words like "has" or "without" much. A high score is boilerplate, a low one a
doubt. A name marks its element and what is below, but not where the element holds the page's main or, without a main, its article. A
header goes wherever it stands; text that is hidden, linked or in noscript or math stays.

Defined results: null and empty pages give an empty text; an empty table gives no
rows; unclosed tags end with their container; an unclosed comment ends with its
first ``>``; an unclosed script or style hides the rest, as in browsers; repeated
rows are each extracted; extra columns are ignored.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn

TOKEN = re.compile(r"""<!--(?:>|->|.*?-->)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*'|["'])*+)>""", re.S)
CLASSES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Names of tags.
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title iframe svg".split())
BAD_TAGS = frozenset("head nav header footer aside form button select dialog menu fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of names that mark menus, footers, sidebars, notices, adverts and reader comments, and such as are used for other things too.
STRONG = frozenset(
    "nav navbar navigation breadcrumb breadcrumbs masthead topbar footer contentinfo sidebar complementary cookie cookies consent gdpr "
    "ad ads adbox advert adverts advertisement advertisements advertising adsense sponsor sponsored newsletter comments disqus respond".split()
)
WEAK = frozenset("menu header notice banner promo form subscribe signup login search comment".split())
#: Words of names that tell of a place, a box, a number of things or what they belong to.
PLACES = frozenset(
    "site page global main primary secondary top bottom left right upper lower inner outer sticky fixed mobile desktop wrap wrapper container box bar area block section row column panel "
    "slot unit list item items body content text link links holder region group thread reply replies reader readers user users policy message google bar div post article entry story blog widget module info law".split()
)
#: Words of names that tell what something is not, or what it is about.
DENYING = frozenset("has have no not non with without on about for of to the than hoc".split())
UNKNOWN, LAST, DENIED, SURE = -0.6, 0.5, -3.0, 1.0

# The labelled table. A block is prose, a short line, one that is a link, or a list of links; so are its neighbours, or there is none.
#: Words, links and link density of examples of each kind.
EXAMPLES = {
    "prose": [(26, 0, 0.0), (60, 2, 0.1), (120, 5, 0.3)],
    "short": [(2, 0, 0.0), (9, 0, 0.0), (18, 1, 0.3)],
    "linked": [(1, 1, 1.0), (7, 1, 0.9), (14, 2, 0.7)],
    "links": [(3, 3, 1.0), (20, 5, 0.7), (72, 12, 1.0)],
    "none": [(0, 0, 0.0)],
}
#: What stays where the page marks no article: kind, then before and after it; "any" is any of the kinds.
STAYS = [
    ("prose", "any", "any"), ("short", "prose", "any"), ("short", "any", "prose"), ("short", "short", "short"), ("short", "short", "linked"), ("short", "linked", "short"), ("short", "short", "links"), ("short", "links", "short"),
    ("short", "short", "none"), ("short", "none", "short"), ("short", "none", "none"), ("linked", "prose", "prose"), ("linked", "prose", "short"), ("linked", "short", "prose"),
]
HEADING_STAYS = [("short", "any", "prose"), ("short", "any", "short"), ("short", "any", "none"), ("linked", "any", "prose"), ("prose", "any", "any")]
#: What stays under a doubtful name, in an article or not.
DOUBT_STAYS = [("prose", "any", "any"), ("short", "prose", "prose"), ("short", "prose", "short"), ("short", "short", "prose"), ("short", "short", "short"), ("short", "prose", "none"), ("short", "none", "prose")]


def labelled() -> list[tuple]:
    """Rows of words, links, density, words and density before, words and density after, in an article, name (0 plain, 1 doubtful, 2 boilerplate), heading, label."""
    kept = lambda table, *kinds: int(any(all(t in ("any", k) for t, k in zip(row, kinds, strict=True)) for row in table))
    out = []
    for kind in ("prose", "short", "linked", "links"):
        for before in EXAMPLES:
            for after in EXAMPLES:
                for i, (n, k, d) in enumerate(EXAMPLES[kind]):
                    (bn, _, bd), (an, _, ad) = EXAMPLES[before][i % len(EXAMPLES[before])], EXAMPLES[after][(i + 1) % len(EXAMPLES[after])]
                    for heading in (0, 1) if n < 20 else (0,):
                        for article in (0, 1):
                            plain = 1 if article else kept(HEADING_STAYS if heading else STAYS, kind, before, after)
                            for name, label in ((0, plain), (1, kept(DOUBT_STAYS, kind, before, after)), (2, 0)):
                                out.append((n, k, d, bn, bd, an, ad, article, name, heading, label))
    return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = 14):
    """A binary tree by Gini impurity: a leaf is its label, a node (feature, cut, below, above)."""
    if depth == 0 or len(set(y)) == 1:
        return int(y.mean() >= 0.5)
    gini = lambda v: 2 * len(v) * v.mean() * (1 - v.mean())
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            below = x[:, f] <= cut
            cost = gini(y[below]) + gini(y[~below])
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, cut, below)
    if best is None:
        return int(y.mean() >= 0.5)
    _, f, cut, below = best
    return (f, float(cut), grow(x[below], y[below], depth - 1), grow(x[~below], y[~below], depth - 1))


def train():
    table = np.array(labelled(), dtype=float)
    return grow(table[:, :-1], table[:, -1])


def decide(tree, row) -> int:
    while not isinstance(tree, int):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def name_level(name: str) -> int:
    """0 for a name that says nothing of boilerplate, 1 for a doubtful one, 2 for one that is sure."""
    words = [w.lower() for w in NAME_WORD.findall(name) if len(w) > 1]
    if not any(w in STRONG or w in WEAK for w in words):
        return 0
    worth = lambda w: 2.0 if w in STRONG else 1.0 if w in WEAK else DENIED if w in DENYING else 0.0 if w in PLACES else UNKNOWN
    score = sum(map(worth, words)) + LAST * (words[-1] in STRONG or words[-1] in WEAK)
    return 2 if score >= SURE else int(score > 0)


def level_of(tag: str, attributes: str) -> int:
    """The highest level of a tag's class, id and role."""
    if not attributes or tag in ("body", "html", "main"):
        return 0
    return max((name_level(name) for m in CLASSES.finditer(attributes) for name in (m[1] or m[2] or m[3] or "").split()), default=0)


def self_closed(attributes: str) -> bool:
    """Whether a tag ends with a slash that is no part of an unquoted value."""
    return attributes.endswith("/") and "=" not in attributes[max(attributes.rfind(c) for c in " \t\r\n\f\"'") + 1 :]


def blocks(html: str) -> list[tuple[str, int, int, float, int, int, int]]:
    """(text, words, links, link density, in article, name, heading) of each block with text."""
    out: list[tuple[str, int, int, float, int, bool, int, int]] = []
    text: list[tuple[str, bool]] = []
    stack: list[tuple[str, bool, int, int]] = []  # open elements: name, boilerplate by a tag here or above, the nearest mark by a name, the main or article
    marks, levels = [0], [0]  # of each mark by a name, the one above, and what the name says
    bodies = [("", 0, 0)]  # mains and articles that may be the page's: tag, the mark above, words
    is_open: dict[str, int] = {}
    links = anchors = 0
    formula = False

    def flush():
        nonlocal text, anchors
        if text:
            whole = " ".join(unescape("".join(t for t, _ in text)).split())
            if whole:
                n = len(whole.split())
                linked = len(unescape(" ".join(t for t, a in text if a)).split())
                article = is_open.get("article", 0) > 0 or is_open.get("main", 0) > 0
                _, bad, mark, body = stack[-1] if stack else ("", False, 0, 0)
                out.append((whole, n, anchors if linked else 0, min(1.0, linked / n), int(article), bad, mark, int(any(is_open.get(h) for h in HEADINGS))))
                bodies[body] = (*bodies[body][:2], bodies[body][2] + n)
            text = []
        anchors = 0

    at = 0
    while True:
        m = TOKEN.search(html, at)
        end = m.start() if m else len(html)
        if end > at:
            text.append((html[at:end], links > 0))
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in RAW and not m[1]:
            if tag == "svg" and self_closed(m[3]):
                continue
            close = re.compile(f"</{tag}[^>]*>", re.I).search(html, at)
            at = close.end() if close else len(html)
            continue
        if tag == "a":
            links = 0 if m[1] else 1
            anchors += links
        if tag == "math":
            formula = not m[1] and not self_closed(m[3])
        if tag in INLINE or formula or tag == "math":
            if tag == "br":
                text.append((" ", links > 0))
            continue
        flush()
        links = 0
        if tag in VOID:
            continue
        if m[1]:
            if is_open.get(tag):
                while True:
                    name = stack.pop()[0]
                    is_open[name] -= 1
                    if name == tag:
                        break
            continue
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
            is_open[stack.pop()[0]] -= 1  # its end tag may be left out
        _, bad, mark, body = stack[-1] if stack else ("", False, 0, 0)
        bad = bad or tag in BAD_TAGS
        level = level_of(tag, m[3])
        if level:
            marks.append(mark)
            levels.append(level)
            mark = len(marks) - 1
        if level < 2 and not bad and (tag == "main" or tag == "article" and not body):
            bodies.append((tag, mark, 0))
            body = len(bodies) - 1
        stack.append((tag, bad, mark, body))
        is_open[tag] = is_open.get(tag, 0) + 1
    flush()
    found = [x for x in bodies if x[0] == "main" and x[2]]
    if not found and (found := [x for x in bodies if x[0] and x[2]]):
        found = [max(found, key=lambda x: (not x[1], x[2]))]  # an article that is not marked, if there is one
    excused = {0}
    for _, mark, _ in found:
        while mark not in excused:
            excused.add(mark)
            mark = marks[mark]
    said = [0]  # of each mark, the most that it and those above say
    for k in range(1, len(marks)):
        said.append(max(said[marks[k]], 0 if k in excused else levels[k]))
    return [(*x[:5], 2 if x[5] else said[x[6]], x[7]) for x in out]


def rows_of(found: list[tuple]) -> list[tuple]:
    """The features of each block, as in the labelled table."""
    none = ("", 0, 0, 0.0, 0, 0, 0)
    sides = zip([none, *found], found, [*found[1:], none], strict=False)
    return [(n, k, d, before[1], before[3], after[1], after[3], article, name, heading) for before, (_, n, k, d, article, name, heading), after in sides]


def main_text(html: str | None, tree) -> str:
    found = blocks(html or "")
    return " ".join(x[0] for x, row in zip(found, rows_of(found), strict=True) if decide(tree, row))


def extract_text(pages: DataFrame) -> DataFrame:
    """One row for each row of pages (page_id, url, html): page_id, url, text, n_chars."""
    tn.small_batches(pages.sparkSession)
    tree = train()

    def run(batches):
        for b in batches:
            texts = [main_text(h, tree) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
