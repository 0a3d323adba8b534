"""Operator 5: the main text of web pages by composite text density.

Method: for every node of the page's tree, characters per tag adjusted for links; the sum of its children's densities;
the subtree of the largest sum is the article. The threshold is the least density on the path from the body to it:
other nodes at or above it bring the largest-sum subtree among theirs.

What is no article text whatever its density leaves the tree first: scripts and the like, hidden elements, menus,
footers, sidebars, notices, adverts, forms, reader comments. A class, id or role says so only by a whole token, one of
the fixed names, or several of them and words of place ("cookie-notice", "sidebar-left"; not "no-sidebar", "ad-free",
"search-results"). A heading, an element that holds the page's main element or an h1, and one that holds most of the
text outside links are never out by name; adverts, comments and the like are, unless they hold the main element. Within
an article an id is a place to link to and says nothing, but for reader comments. The header of an article or main element stays; another one
is the page's, unless the article found holds it and it has a heading and more text than links.

A null, empty or text-free page gives an empty text. Malformed pages are read as browsers do, near enough: open elements
end with their ancestors, a paragraph ends where a block begins. Whole pages are read, whatever their length and depth,
in time in proportion to their length. One narrow pass, no shuffle.
"""

from __future__ import annotations

import html
import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provlake.runtime import bounded_batches, ship

# A value's quotes count after an equals sign only; an unclosed one is no quote.
_VALUES = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+(?:>|\Z)"""
_TAG = re.compile(rf"""<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([A-Za-z][^\s/>]*+)({_VALUES}))""", re.S)
_ATTR = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""")
_WORD = re.compile(r"[a-z]+")
_NOT_SHOWN = re.compile(r"display\s*:\s*none")
# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes template xmp".split())
GONE = frozenset(
    "script style noscript template head title button select textarea iframe object svg canvas audio video noembed noframes".split()
)
BLOCK = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead
    tr ul caption option""".split()
)
ENDS_PARAGRAPH = BLOCK - frozenset("body html tbody td tfoot th thead tr caption option".split())
#: Markup of words within a block: it is no structure, so its text counts as its parent's.
INLINE = frozenset(
    """abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span
    strike strong sub sup time tt u var wbr""".split()
)
#: An open element of the key ends when one of the values begins, unless one of the stops is nearer.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Words of a class, id or role that name what is no article text.
NOISE = frozenset(
    """nav navbar navigation menu sidebar footer banner notice notices alert popup modal overlay share sharing social
    related recommended breadcrumb breadcrumbs pagination pager toolbar masthead complementary contentinfo search""".split()
)
PAGE_ONLY = frozenset({"header", "topbar"})
#: Names of what is no article text even where it is most of the page.
NEVER = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion comment comments disqus respond
    cookie cookies consent gdpr newsletter subscribe subscription login signup""".split()
)
#: Of these, what an id says within an article too.
READERS = frozenset("comment comments disqus respond thread".split())
#: Words that may stand beside these in one token and leave its meaning.
PLACES = frozenset(
    """left right top bottom main primary secondary global site wrapper container inner outer box bar block area slot
    unit widget list links item items icons buttons""".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a node can hold, as bits.
MAIN, ARTICLE, H1, HEADING = 1, 2, 4, 8
_BIT = {"main": MAIN, "article": ARTICLE, "h1": H1 | HEADING} | dict.fromkeys(("h2", "h3", "h4", "h5", "h6"), HEADING)
#: Elements that are no article text, and the elements that make one of them a frame of the page's content instead.
BY_TAG = dict.fromkeys(("nav", "footer", "aside", "menu"), MAIN) | dict.fromkeys(("form", "dialog"), MAIN | ARTICLE)
#: What a node is by its name or tag.
USUAL, NAMED, NEVER_TEXT, TAGGED, PAGE_HEADER = range(5)
FRAMES = ("#root", "html", "body")


class Tree:
    """Nodes as parallel lists, parents before children; each node's parts are texts and node numbers in page order."""

    def __init__(self) -> None:
        self.tag, self.parent, self.parts, self.kind = ["#root"], [-1], [[]], [USUAL]

    def add(self, tag: str, parent: int, kind: int = USUAL) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.parts.append([])
        self.kind.append(kind)
        self.parts[parent].append(len(self.tag) - 1)
        return len(self.tag) - 1


def _attributes(text: str) -> dict[str, str]:
    return {name.lower(): a or b or c for name, a, b, c in reversed(_ATTR.findall(text))}


def _kind(tag: str, attrs: str, within: bool) -> int | None:
    """What an element is, within an article or main element or not; None: it is not shown at all."""
    if tag in GONE:
        return None
    found = _attributes(attrs) if len(attrs) > 1 else {}
    if tag not in FRAMES and found:
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _NOT_SHOWN.search(found.get("style", "").lower()):
            return None
    if tag in BY_TAG:
        return TAGGED
    if tag == "header" and not within:
        return PAGE_HEADER
    if tag in FRAMES or tag in ("article", "main") or tag in HEADINGS:
        return USUAL
    kind = USUAL
    for name in ("class", "role", "id"):
        for token in found.get(name, "").lower().split():
            words = {w for w in _WORD.findall(token) if len(w) > 1}
            if name == "id" and within and not (words and words <= READERS):
                continue
            if words & NEVER and words <= NEVER | NOISE | PLACES | READERS:
                return NEVER_TEXT
            said = words & NOISE if within else words & (NOISE | PAGE_ONLY)
            if said and words - said <= PLACES:
                kind = NAMED
    return kind


def parse(page: str) -> Tree:
    """The tree of all that is shown."""
    tree, at = Tree(), 0
    names, nodes, gone = ["#root"], [0], [False]  # of each open element; nodes: where its text goes
    places: dict[str, list[int]] = {}  # of each name, where in the list of open elements it stands
    hidden = within = 0

    def text(part: str) -> None:
        if part and not hidden:
            tree.parts[nodes[-1]].append(html.unescape(part) if "&" in part else part)

    def close(to: int) -> None:
        nonlocal hidden, within
        while len(names) > to:
            tag = names.pop()
            places[tag].pop()
            hidden -= gone.pop()
            within -= tag in ("article", "main")
            nodes.pop()

    def nearest(of: set[str]) -> int:
        return max((places[x][-1] for x in of if places.get(x)), default=0)

    while m := _TAG.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            if places.get(tag):
                close(places[tag][-1])
            continue
        if tag in ENDS_PARAGRAPH and places.get("p"):
            close(places["p"][-1])
        if tag in ENDS:
            ended, stops = map(nearest, ENDS[tag])
            if ended > stops:
                close(ended)
        if tag in VOID:
            if tag == "br":
                text(" ")
            elif not hidden and tag != "wbr":
                tree.add(tag, nodes[-1])
            continue
        if tag in RAW:
            end = re.compile("</" + tag, re.I).search(page, at)
            at = end.start() if end else len(page)
        if tag in ("html", "body") and places.get(tag):
            continue
        kind = _kind(tag, m[3], within > 0) if not hidden else USUAL
        hidden += kind is None
        gone.append(kind is None)
        names.append(tag)
        places.setdefault(tag, []).append(len(names) - 1)
        nodes.append(nodes[-1] if hidden or tag in INLINE and kind == USUAL else tree.add(tag, nodes[-1], kind))
        within += tag in ("article", "main")
    text(page[at:])
    return tree


def cleaned(tree: Tree) -> Tree:
    """The tree without what is no article text."""
    n = len(tree.tag)
    chars, linked = [0] * n, [0] * n
    holds = [0] * n
    for k in range(n - 1, -1, -1):
        chars[k] += sum(len("".join(x.split())) for x in tree.parts[k] if x.__class__ is str)
        if tree.tag[k] == "a":
            linked[k] = chars[k]
        if (up := tree.parent[k]) >= 0:
            chars[up] += chars[k]
            linked[up] += linked[k]
            holds[up] |= holds[k] | _BIT.get(tree.tag[k], 0)
    whole = chars[0] - linked[0]
    out, new = Tree(), [0] + [-1] * (n - 1)
    for k in range(n):
        if new[k] < 0:
            continue
        for x in tree.parts[k]:
            if x.__class__ is str:
                out.parts[new[k]].append(x)
                continue
            kind, most = tree.kind[x], 2 * (chars[x] - linked[x]) > whole
            if kind == NEVER_TEXT:
                gone = not holds[x] & MAIN
            elif kind == TAGGED:
                gone = not holds[x] & BY_TAG[tree.tag[x]] and not (most and holds[x] & H1 and tree.tag[x] in ("form", "dialog"))
            elif kind == NAMED:
                gone = not holds[x] & (MAIN | H1) and not most
            elif kind == PAGE_HEADER and not holds[x] & (MAIN | ARTICLE):
                gone = not holds[x] & HEADING or 2 * linked[x] >= chars[x]
            else:
                kind, gone = USUAL, False
            if not gone:
                new[x] = out.add(tree.tag[x], new[k], kind if kind == PAGE_HEADER else USUAL)
    return out


def densities(tree: Tree) -> tuple[list[float], list[float]]:
    """Each node's link-adjusted characters per tag, and the sum over its children (its own if it has none)."""
    n = len(tree.tag)
    chars, tags, linked, links = ([0] * n for _ in range(4))
    for k in range(n - 1, -1, -1):
        chars[k] += sum(len(" ".join(x.split())) for x in tree.parts[k] if x.__class__ is str)
        if tree.tag[k] == "a":
            linked[k] = chars[k]
        if (up := tree.parent[k]) >= 0 and tree.kind[k] != PAGE_HEADER:
            chars[up] += chars[k]
            tags[up] += tags[k] + 1
            linked[up] += linked[k]
            links[up] += links[k] + (tree.tag[k] == "a")
    ratio = linked[0] / max(1, chars[0])
    density, sums = [0.0] * n, [0.0] * n
    for k in range(n - 1, -1, -1):
        if c := chars[k]:
            t, lc, lt = max(1, tags[k]), linked[k], max(1, links[k])
            base = math.log(c / max(1, c - lc) * lc + ratio * c + math.e)
            # Without links in the page the base of the logarithm is 1: plain characters per tag.
            density[k] = c / t * (math.log(max(1.0, c / max(1, lc) * t / lt)) / math.log(base) if ratio else 1.0)
        if not any(x.__class__ is int for x in tree.parts[k]):
            sums[k] = density[k]
        if (up := tree.parent[k]) >= 0 and tree.kind[k] != PAGE_HEADER:
            sums[up] += density[k]
    return density, sums


def main_nodes(tree: Tree) -> set[int]:
    density, sums = densities(tree)
    n = len(tree.tag)
    best = list(range(n))  # of each node, the node of the largest sum in its subtree; the outermost on ties
    for k in range(n - 1, 0, -1):
        up = tree.parent[k]
        better = sums[best[k]] > sums[best[up]] or (sums[best[k]] == sums[best[up]] and best[up] != up and best[k] < best[up])
        if better and tree.kind[k] != PAGE_HEADER:
            best[up] = best[k]
    least, k = density[best[0]], best[0]
    while k > 0:
        if tree.tag[k] not in ("html", "#root"):
            least = min(least, density[k])
        k = tree.parent[k]
    apart = [False] * n  # in a header that may be the page's
    for k in range(1, n):
        apart[k] = tree.kind[k] == PAGE_HEADER or apart[tree.parent[k]]
    return {best[k] for k in range(n) if density[k] >= least and density[k] > 0 and not apart[k]}


def extract(page: str | None) -> str:
    if not page:
        return ""
    tree = cleaned(parse(page))
    chosen = main_nodes(tree)
    blocks: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if block := " ".join("".join(held).split()):
            blocks.append(block)
        held.clear()

    # inside: 0 outside the article; 1 in it by the page's frame only; 2 in an element that was found.
    todo: list[tuple[int | str, int, bool]] = [(0, 0, False)]
    while todo:
        k, inside, leaving = todo.pop()
        if leaving:
            flush()
        elif k.__class__ is str:
            held.append(k)
        elif tree.kind[k] != PAGE_HEADER or inside == 2:
            if k in chosen:
                inside = max(inside, 1 if tree.tag[k] in FRAMES else 2)
            if tree.tag[k] in BLOCK or k in chosen:
                flush()
                todo.append((k, inside, True))
            todo += [(x, inside, False) for x in reversed(tree.parts[k]) if inside or x.__class__ is int]
    flush()
    return "\n\n".join(blocks)


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars of every page."""
    ship(df.sparkSession)
    bounded_batches(df.sparkSession)

    @F.pandas_udf("string")
    def texts(pages: pd.Series) -> pd.Series:
        return pd.Series([extract(p) for p in pages], dtype=object)

    out = df.select(df[id_col].alias(id_col), df[url_col].alias(url_col), texts(df[html_col]).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
