"""Main-text extraction: flat text blocks classified by a decision tree over word counts and link densities.

A page is cut into blocks at block-level tags. A block's features are its own
words and link density, those of the block before and after it, and raw
signals of its place: heading, inside or outside of the page's article, the
kind of tag around it, how much a class name around it says, and the share of
the page's text in that element. What these mean is left to a tree that is
grown from a small labelled table of blocks.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaframe.llm.shingles import text_slices

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:"[^"]*"|'[^']*'|[^'"<>])*+)>|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>|<[!?/][^<>]*>""", re.S)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS, _CAMEL = re.compile(r"[^a-z0-9]+"), re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Text inside these is no text of the page.
_SILENT = {"script", "style", "noscript", "template", "svg", "iframe", "title", "textarea", "select", "object", "canvas", "audio", "video", "annotation", "annotation-xml"}
#: Of these, the ones whose content is raw text: tags inside mean nothing, and without an end tag they go on to the page's end.
_RAW = {"script", "style", "iframe", "title", "textarea"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_INLINE |= {"annotation", "annotation-xml", "maction", "math", "menclose", "merror", "mfrac", "mi", "mmultiscripts", "mn", "mo", "mover", "mpadded", "mphantom", "mprescripts", "mroot", "mrow", "ms", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtable", "mtd", "mtext", "mtr", "munder", "munderover", "semantics"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_PROSE = {"article", "main"}
_OTHER = {"nav", "footer", "aside", "button", "menu", "dialog", "label", "legend", "head"}
#: Tags that are sometimes around everything.
_LOOSE = {"form", "fieldset", "header"}
#: Words that, beside one of the hints, make a name one of a page's layout.
_LAYOUT = {"body", "container", "content", "grid", "has", "is", "layout", "main", "no", "page", "result", "results", "single", "template", "with", "without", "wrap", "wrapper"}
#: Words in class, id or role that name something other than the article.
_HINTS = {"ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "captcha", "comment", "commentlist", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "copyright", "disclaimer", "disqus", "feedback", "foot", "footer", "form", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "overlay", "pager", "pagination", "popup", "promo", "recommended", "register", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "tags", "teaser", "toolbar", "topbar", "trending", "warning", "widget"}

FEATURES = ("words", "words_before", "words_after", "links", "links_before", "links_after", "heading", "place", "tag", "hint", "share")

#: The labelled table's pages, each laid out PAGES times with its ranges drawn anew. An item is marks, words from-to, most blocks, share of
#: words in links, and label. Marks: a article or main, h heading, f form or header, n other tags such as nav and footer, w a class that
#: also names a layout, s a class that names something else. Blocks of one page with the same marks are in one element.
LAYOUTS = """
n1-3*6/1- s6-15*1/0- ah4-12*1/0+ a15-120*6/.03+ n4-14*1/.1-
n1-2*5/1- ah3-10*1/0+ a1-4*2/0+ a30-90*3/.05+ a1-6*2/0+ a40-130*2/.02+ a2-9*2/0+ n3-9*1/.5-
n1-3*4/1- ah4-9*1/0+ a40-90*2/.05+ ah2-6*1/0+ a5-30*3/.1+ a30-60*2/.3+ a20-90*2/.02+ n4-14*1/0-
n1-3*3/1- ah4-9*1/0+ a2-9*5/1- a40-90*2/.08+ a25-70*2/.3+ n1-4*4/1-
n1-3*3/1- a2-5*5/1- ah4-9*1/0+ a50-90*2/.1+ a3-9*4/1- a40-90*2/.25+ n4-9*2/.2-
n1-3*3/1- ah4-9*1/0+ a30-60*1/.05+ a6-26*1/1+ a30-60*1/.05+ a7-14*1/1+ a30-60*2/.05+ n4-9*1/0-
n1-3*3/1- ah4-9*1/0+ a20-80*2/.04+ as4-20*1/0- a15-80*3/.04+ as5-60*4/.03- n4-14*1/.1-
n1-3*3/1- ah4-9*1/0+ a20-80*2/.04+ an10-60*2/.2- a5-80*3/.04+ af1-6*3/0- a10-60*1/0+ as8-70*2/.05-
n1-3*3/1- awh4-9*1/0+ aw15-90*5/.03+ aw1-7*2/0+ aw12-60*2/.2+ n4-14*1/.1-
n1-3*4/1- ah4-9*1/0+ a20-90*4/.05+ a2-60*1/.1+
ah4-9*1/0+ a20-90*3/.05+ a10-60*1/.2+ a1-9*1/0+
n1-3*3/1- ah1-6*1/0+ a1-9*5/.15+ as4-30*2/0- n3-9*1/0-
ah1-6*1/0+ a2-12*6/.2+ n1-3*3/1-
ah4-9*1/0+ a20-90*2/.05+ a1-4*4/1-
1-3*5/1- h3-9*1/0+ 20-110*4/.05+ 2-60*1/.1+
2-60*1/.05+
2-60*3/.02+
n1-3*5/1- 2-40*2/.05+
h2-9*1/0+ 3-60*2/.05+
h3-9*1/0+ 20-110*3/.05+ 15-60*1/.2+ 3-20*1/0+
n1-3*4/1- wh4-9*1/0+ w20-110*4/.05+ w2-60*1/.05+
n1-3*4/1- fh4-9*1/0+ f20-110*4/.05+ f20-60*1/.05+
10-40*1/0- ah4-9*1/0+ a20-90*4/.05+ 10-60*2/0- 5-20*3/.6- 40-90*1/.05- n4-9*1/0-
n1-3*3/1- h3-9*1/0- ah4-9*1/0+ a20-90*4/.05+ h2-4*1/0- s20-80*3/.05- w10-60*2/.1- f1-20*2/.1-
1-4*6/1- h5-9*1/0+ 30-110*5/.05+ 3-12*1/0+ 30-90*2/.08+ 4-8*3/.9-
1-3*5/1- h3-9*1/0+ 40-90*1/.02+ h2-6*1/0+ 1-9*2/0+ 25-80*3/.15+ 1-6*2/0+ n4-14*1/.1-
n1-3*5/1- h3-9*1/0+ 15-60*4/.05+ 15-60*3/.25+ 2-12*2/0+ n4-30*2/.05-
s2-9*2/0- h3-9*1/0+ 20-90*6/.04+ s5-60*7/.03- n4-14*1/0-
s10-50*1/.1- h4-9*1/0+ 25-90*5/.04+ 2-9*1/0+ s5-40*3/.05- s1-3*5/1-
n1-3*4/1- wh4-9*1/0+ w20-90*5/.05+ w2-9*2/0+ s20-70*3/.03- n4-14*1/.1-
n1-3*4/1- wh4-9*1/0+ w15-90*4/.1+ n1-3*6/1- s20-70*5/.03- n4-14*1/.1-
1-3*4/1- wh4-9*1/0+ w15-90*4/.1+ w1-3*6/1- s10-70*5/.03-
10-60*2/0+ h4-9*1/0+ 20-90*3/.05+ w20-90*4/.05+ w2-9*1/0+ s5-40*2/.05-
f1-3*4/1- fh4-9*1/0+ f20-100*5/.05+ f12-60*1/.2+ s20-70*3/.03- n4-14*1/.1-
w1-3*5/1- wh4-9*1/0+ w20-110*6/.05+ w2-8*2/0+ w20-60*2/.25+ w3-8*3/.9-
n1-3*4/1- wh4-9*1/0+ w15-110*7/.05+ w1-8*2/0+ w30-60*1/.2+ n4-14*1/.1-
1-3*4/1- h4-9*1/0+ 40-100*5/.05+ 2-8*1/0+ w4-14*1/.1- w15-40*1/.1- w2-6*2/.9-
f1-3*5/1- fh4-9*1/0+ f20-100*6/.05+ f12-60*2/.2+ n4-14*1/.1-
1-3*4/1- h4-9*1/0+ 30-100*5/.05+ f1-6*4/0- f10-40*1/.1- n1-5*3/1-
n1-3*8/1- n6-40*2/0- n2-5*3/.8-
n1-3*4/1- s20-60*2/0- n6-20*1/0-
h3-6*1/0+ 25-100*4/.05+ 3-20*7/.95-
1-5*5/1- 3-20*9/.95- 1-5*4/1-
n1-2*5/1- h3-8*1/0+ 2-8*8/0+ n3-9*1/0-
h3-8*1/0+ 20-110*5/.3+ 2-8*3/.9- n4-9*1/.1-
1-4*4/1- 20-90*1/.05+ 1-5*3/1- h4-8*1/0+ 20-100*4/.1+ 8-25*1/.5+ 30-80*1/.1+ 2-6*3/1-
"""
PAGES = 16


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """LAYOUTS as features and labels."""
    rng = random.Random(11)
    rows, kept = [], []
    for line in LAYOUTS.strip().split("\n"):
        items = re.findall(r"([a-z]*)(\d+)-(\d+)\*(\d+)/([.\d]+)([+-])", line)
        for _ in range(PAGES):
            page = []
            for marks, low, high, most, share, label in items:
                for _ in range(rng.randint((int(most) + 1) // 2, int(most))):
                    n = rng.randint(int(low), int(high))
                    linked = n if share == "1" else min(n, round(n * float(share) * rng.uniform(0, 2)))
                    around = marks.replace("h", "").replace("a", "")
                    page.append(Block("", n, linked, "h" in marks, "a" in marks, 2 * ("n" in marks) or int("f" in marks), 2 * ("s" in marks) or int("w" in marks), marks.replace("h", "") if around else None))
                    kept.append(label == "+")
            rows += features(page)
    return np.array(rows, float), np.array(kept, bool)


class Block(NamedTuple):
    text: str
    words: int
    linked: int  # words in links
    heading: bool
    prose: bool  # in an article or main
    tag: int  # 0 nothing, 1 form or header, 2 nav, footer and the like
    hint: int  # 0 nothing, 1 a class that also names a layout, 2 a class that names something else
    element: object  # the innermost element that a tag or hint is of, if any


def features(blocks: list[Block]) -> list[tuple]:
    """A row of FEATURES for each block of a page."""
    words = [0, *(b.words for b in blocks), 0]
    links = [0.0, *(b.linked / b.words if b.words else 0.0 for b in blocks), 0.0]
    article = any(b.prose and not b.tag and not b.hint for b in blocks)
    held: Counter = Counter()
    for b in blocks:
        if 3 * b.linked <= b.words:
            held[b.element] += b.words
    total = sum(held.values()) or 1
    place = lambda b: (1 if b.prose else -1) if article else 0
    return [(words[i + 1], words[i], words[i + 2], links[i + 1], links[i], links[i + 2], int(b.heading), place(b), b.tag, b.hint, held[b.element] / total if b.element is not None else 0.0) for i, b in enumerate(blocks)]


Tree = bool | tuple  # a verdict, or (feature, threshold, tree up to it, tree above it)


def grow_tree(x: np.ndarray, y: np.ndarray, depth: int = 12, least: int = 4) -> Tree:
    """A decision tree by the Gini impurity; leaves hold ``least`` rows or more."""
    if not depth or y.all() or not y.any():
        return bool(2 * y.sum() > len(y))
    best = (2 * y.mean() * (1 - y.mean()) * len(y) - 1e-9, None)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        n = np.flatnonzero(v[1:] > v[:-1]) + 1
        n = n[(n >= least) & (n <= len(y) - least)]
        if len(n):
            k, rest = ones[n - 1], ones[-1] - ones[n - 1]
            costs = 2 * (k * (n - k) / n + rest * (len(y) - n - rest) / (len(y) - n))
            at = n[costs.argmin()]
            if costs.min() < best[0]:
                best = costs.min(), (f, (v[at - 1] + v[at]) / 2)
    if best[1] is None:
        return bool(2 * y.sum() > len(y))
    f, threshold = best[1]
    low = x[:, f] <= threshold
    below, above = (grow_tree(x[part], y[part], depth - 1, least) for part in (low, ~low))
    return below if isinstance(below, bool) and below is above else (f, float(threshold), below, above)


@lru_cache(maxsize=1)
def trained_tree() -> Tree:
    return grow_tree(*labelled_table())


def keeps(tree: Tree, row: tuple) -> bool:
    while not isinstance(tree, bool):
        f, threshold, low, high = tree
        tree = low if row[f] <= threshold else high
    return tree


def _hint(attributes: str) -> int:
    """What a tag's class, id and role say: 2 if one of their names is of something else than the article, 1 if such a name also names a layout."""
    said = 0
    for found in _NAMED.finditer(attributes):
        for name in (next((v for v in found.groups() if v), "")).split():
            parts = set(_PARTS.split(_CAMEL.sub("-", name).lower()))
            if parts & _HINTS:
                said = max(said, 1 if parts & _LAYOUT else 2)
    return said


def text_blocks(page: str) -> list[Block]:
    """The blocks with text, in page order.

    Neither tag nor class says anything about an element that holds the page's
    whole article: a main, or every outermost article whose own names are no
    hint. Text is left out inside silent elements; one without an end tag ends
    with its parent, unless its content is raw text. Linear in the page.
    """
    blocks, wrappers = _blocks(page, frozenset())
    return _blocks(page, wrappers)[0] if wrappers else blocks


class _Open(NamedTuple):
    name: str
    tag: int
    hint: int
    prose: bool
    begin: int


def _blocks(page: str, wrappers: frozenset[int]) -> tuple[list[Block], frozenset[int]]:
    """The blocks, where tags and hints of the elements that begin at ``wrappers`` count for nothing; such elements found."""
    blocks: list[Block] = []
    plain: list[str] = []
    linked: list[str] = []  # the same text, only what is in links
    stack: list[_Open] = []  # open elements that count
    standing: Counter[str] = Counter()  # the same by name
    marked: list[_Open] = []  # those of them with a tag or hint, outermost first
    inside: list[str] = []  # in a silent element: it and the elements open in it
    opened: Counter[str] = Counter()  # the same by name
    around: frozenset[int] | None = None  # marked elements around every outermost article
    mains: set[int] = set()  # and around a main
    prose = 0
    heading, in_link, at, n = False, False, 0, len(page)
    lowered = ""

    def close() -> None:
        if plain:
            words = html.unescape("".join(plain)).split()
            if words:
                tag, hint = max((o.tag for o in marked), default=0), max((o.hint for o in marked), default=0)
                blocks.append(Block(" ".join(words), len(words), min(len(words), len(html.unescape("".join(linked)).split())), heading, prose > 0, tag, hint, marked[-1].begin if marked else None))
            plain.clear()
            linked.clear()

    def pop() -> _Open:
        nonlocal prose
        gone = stack.pop()
        standing[gone.name] -= 1
        prose -= gone.prose
        if marked and marked[-1] is gone:
            marked.pop()
        return gone

    while at < n:
        tag = _TAG.search(page, at)
        begin = tag.start() if tag else n
        if begin > at and not inside:
            plain.append(page[at:begin])
            if in_link:
                linked.append(page[at:begin])
        if not tag:
            break
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            continue
        ends, attributes = tag[1] or tag[4], tag[3] or tag[6] or ""
        if name in _RAW and not ends:
            if not attributes.endswith("/"):
                lowered = lowered or page.lower()
                if len(lowered) != n:
                    lowered = re.sub("[A-Z]+", lambda m: m[0].lower(), page)
                stop = lowered.find(f"</{name}", at)
                at = n if stop < 0 else (page.find(">", stop) + 1 or n)
            if not inside:
                close()
            continue
        if inside:
            if not ends:
                if name not in _VOID and not attributes.endswith("/"):
                    inside.append(name)
                    opened[name] += 1
                continue
            if opened[name]:
                while True:
                    opened[last := inside.pop()] -= 1
                    if last == name:
                        break
                continue
            inside.clear()  # the parent's end
            opened.clear()
        if name in _SILENT:
            if not ends and not attributes.endswith("/"):
                inside.append(name)
                opened[name] += 1
            if name not in _INLINE:
                close()
            continue
        if name == "a":
            in_link = not ends
        hint = _hint(attributes) if attributes and not ends and name not in ("html", "body") else 0
        if name in _INLINE:
            if name == "br":
                plain.append(" ")
                if in_link:
                    linked.append(" ")
            if ends or name in _VOID or not hint:
                if ends and stack and stack[-1].name == name:
                    close()
                    pop()
                continue
        close()
        if ends:
            if name[0] == "h" and name[1:].isdigit():
                heading = False
            if standing[name]:
                while pop().name != name:
                    pass
            continue
        heading = name[0] == "h" and name[1:].isdigit()
        if stack and stack[-1].name in ("p", "li", "td") and name in ("p", "li", "td"):
            pop()
        if name in _VOID or attributes.endswith("/"):
            continue
        if name == "main":
            mains |= {o.begin for o in marked}
        elif name == "article" and not prose and not hint:
            around = frozenset(o.begin for o in marked) if around is None else around & {o.begin for o in marked}
        kind = 0 if begin in wrappers or name in _PROSE else 1 if name in _LOOSE and not (name == "header" and prose) else 2 if name in _OTHER else 0
        if begin in wrappers or name == "main" or (name == "header" and prose and hint < 2):
            hint = 0
        if kind or hint or name in _PROSE or name in ("div", "section", "ul", "ol", "table"):
            stack.append(_Open(name, kind, hint, name in _PROSE, begin))
            standing[name] += 1
            prose += name in _PROSE
            if kind or hint:
                marked.append(stack[-1])
    close()
    return blocks, frozenset(mains | (around or frozenset()))


def main_text(page: str, tree: Tree | None = None) -> str:
    """The text of the blocks that the tree keeps, one a line."""
    blocks, tree = text_blocks(page), trained_tree() if tree is None else tree
    return "\n".join(b.text for b, row in zip(blocks, features(blocks), strict=True) if keeps(tree, row))


def _extract(batches: Iterator[pa.RecordBatch], tree: Tree) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch, "html"):
            texts = [main_text(t, tree) if t else "" for t in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url_col, text and n_chars (code points) of each page's main text.

    Character references are decoded, white space inside a block is one space,
    blocks are joined by a line feed in page order. A null or empty page has an
    empty text. Null or repeated ids and repeated rows are kept; other columns
    are ignored. There is no shuffle.
    """
    types = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    found = rows.mapInArrow(partial(_extract, tree=trained_tree()), f"id {types[id_col]}, url {types[url_col]}, text string, n_chars long")
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
