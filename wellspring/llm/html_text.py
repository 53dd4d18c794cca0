"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering.

The standard library's parser streams events.  Block elements end a line; a line knows its text, its tags,
the text inside links and the element that it stands in.  Elements form a tree of parent links, numbered in
page order, so that what an element holds, and what is inside it, comes from one pass over the numbers.

Marks.  Navigation, footers, asides, dialogs, scripts, hidden parts, adverts and reader comments are never
content.  Headers outside the article, forms, and elements whose class, id, role or label names a side part
are boilerplate that an ``article`` or ``main`` inside them escapes.  A name is read without element and modifier
(after ``__`` or ``--``), vendors, numbers and sizes.  It marks if each word names or qualifies a part
(``comment-list``), or if it begins with a word that names nothing but such a part (``comments-anything``);
``search-methods``, ``share-price`` and ``no-sidebar`` do neither.  A form that holds most of the page's paragraphs, and a named wrapper around
nearly the whole page where no article is, are content.

The other lines' text-to-tag ratios are smoothed with a Gaussian and cut at a threshold from their spread;
lines above it are the content cluster.  The main element is the ``article`` or ``main`` that holds most of
the cluster's text, and the page's text is its headings, paragraphs and list items that are not boilerplate, so a
short one stays wherever it is, and of its other lines (bare text of ``div`` and the like) those of the cluster
and those between them, unless they are mostly links; an ``h1`` just before it belongs to it if it has none.  Without such an element the
deepest element that holds most of the cluster is taken: of its lines those of the cluster, headings and
paragraphs, and what stands between lines of the cluster, less what is mostly links.

Character references are decoded, white space inside a line becomes one space, lines are trimmed and joined
by one space in page order.

How it scales.  Each page is read once, in time and memory linear in its length however deep its elements
nest or stay open.  Nothing is shuffled.

Defined results.  Null html counts as empty and gives an empty text.  Null ids or urls, repeated rows and
other columns pass through or are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NEVER = frozenset("nav footer aside menu menuitem dialog button select option textarea input iframe object applet canvas svg noscript template head title script style".split())
FORMS = frozenset(("form", "fieldset"))
SILENT = frozenset("script style head title noscript template svg iframe object textarea select".split())
#: What may stand in a head; any other element ends it.
HEAD = frozenset("base link meta noscript script style template title".split())
#: Elements that a start tag of the named kind closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
P_CLOSERS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = HEADINGS | frozenset("p li blockquote pre td th dd dt figcaption".split())
#: Words of a name that mark a part as boilerplate.
PARTS = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs header masthead topbar footer sidebar aside rail widget widgets ad ads adv advert adverts advertisement advertising adslot adsbygoogle banner "
    "sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing social "
    "comment comments commentlist disqus replies reply related recommended recommendations trending pagination pager toolbar skip complementary contentinfo dialog".split()
)
#: Those that also mark an ``article`` as not the page's own, and that no article inside them escapes.
OTHERS = frozenset("ad ads adsbygoogle adslot advert adverts advertisement advertising sponsor sponsored promo promotion promoted comment comments commentlist disqus replies reply related recommended recommendations trending teaser teasers popup modal overlay".split())
#: Words that qualify a part without naming one.
WITH = frozenset(
    "site page main top bottom left right primary secondary global local inner outer list lists item items area box bar wrap wrapper container block section group row col column link links icon icons "
    "button buttons form post posts article articles story stories user reader slot unit content text message google third first second sub mini sticky js the of on to for us our by in and "
    "body author avatar meta date count thread title field input email cta trail iframe frame law info policy settings area zone label hidden visible open closed active".split()
)
#: Words that name nothing but a side part, so that a class or id that begins with them is one, whatever follows.
FIRST = frozenset("comments commentlist disqus adsbygoogle advert adverts advertisement advertising adslot gdpr newsletter breadcrumb breadcrumbs sidebar navbar navigation footer masthead topbar pagination popup sponsored".split())
#: Those that do so alone, before an element or modifier.
SINGLE = frozenset("comment ad ads nav menu header cookie promo related share sharing social subscribe signup login banner widget".split())
#: Makers of page parts, whose names stand before those of the parts.
VENDORS = frozenset("wp fb google gpt dfp js block facebook twitter jetpack elementor onetrust uc mc mailchimp".split())
_SIZE = re.compile(r"[0-9]+(?:x[0-9]+)?|.", re.S)
_SPACE = re.compile(r"\s+")
_CUT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SIGMA = 1.0
#: Share of the page's text from which a named wrapper without an article in the page counts as content.
WRAPS = 0.8


def names(attrs: list[tuple[str, str | None]]) -> set[str]:
    """Part words of an element's names: of each name whose words all name or qualify a part."""
    found: set[str] = set()
    for k, v in attrs:
        if not v or k not in ("class", "id", "role", "aria-label"):
            continue
        for name in [v] if k == "aria-label" else v.split():
            block = name.split("__")[0].split("--")[0] if k != "aria-label" else name
            words = [w for w in (p.lower() for p in _CUT.split(block)) if w and not _SIZE.fullmatch(w)]
            while len(words) > 1 and words[0] in VENDORS:
                words = words[1:]
            here = {w for w in words if w in PARTS or w in OTHERS or w in FIRST}
            first = bool(words) and words[0] in FIRST or block != name and " ".join(words) in SINGLE
            if here and (first or all(w in here or w in WITH for w in words)):
                found |= here & (PARTS | OTHERS) or {"sidebar"}
    return found


def mark(tag: str, attrs: list[tuple[str, str | None]], inside_main: bool) -> int:
    """0 for content; 1 for a part that a page may wrap around its article; 2 for what is never content."""
    if tag in NEVER:
        return 2
    for k, v in attrs:
        if k == "hidden" or k == "aria-hidden" and (v or "").lower() == "true" or v and k == "style" and _HIDDEN.search(v):
            return 2
    if not attrs:
        return int(tag in FORMS or tag == "header" and not inside_main)
    found = names(attrs)
    if tag in ("html", "body", "main", "article"):
        return 2 if tag == "article" and found & OTHERS else 0
    if found & OTHERS:
        return 2
    if inside_main:
        found -= {"header", "notice", "notices"} if tag in ("header", "hgroup") else {"header"}
    return int(bool(found) or tag in FORMS or tag == "header" and not inside_main)


class Lines(HTMLParser):
    """The tree of elements (number 0 is the page) and its lines, in page order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.marks, self.mains, self.in_main = [""], [0], [0], [False], [False]
        self.stack: list[int] = []
        self.open: dict[str, list[int]] = {}  # places on the stack by tag
        self.blocks: list[int] = []  # of elements that are not inline
        self.walls: list[int] = []  # of those that end the search for what a start tag closes
        self.text: list[str] = []
        self.ratio: list[float] = []
        self.links: list[int] = []
        self.at: list[int] = []  # the element of a line
        self.block: list[int] = []  # the nearest one that is not inline
        self.parts: list[str] = []
        self.tags = self.linked = 0

    def end_line(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                self.text.append(text)
                self.ratio.append(len(text) / (self.tags + 1))
                self.links.append(self.linked)
                self.at.append(self.stack[-1] if self.stack else 0)
                self.block.append(self.stack[self.blocks[-1]] if self.blocks else 0)
            self.parts = []
        self.tags = self.linked = 0

    def cut(self, place: int) -> None:
        """Closes all elements from a place on the stack on."""
        while len(self.stack) > place:
            tag = self.tag[self.stack.pop()]
            self.open[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()
                if tag not in ("p", "td", "th"):
                    self.walls.pop()

    def close_before(self, tag: str) -> None:
        """Closes what a start tag ends: what is still open inside the nearest such element ends with it."""
        shut = CLOSES.get(tag, ())
        if tag in P_CLOSERS:
            shut = {"p", *shut}
        while shut:
            place = max((p[-1] for t in shut if (p := self.open.get(t))), default=-1)
            if place < (self.walls[-1] if self.walls else 0):
                break
            self.cut(place)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
            return
        if tag == "hr":
            self.end_line()
        if tag in VOID:
            return
        if self.open.get("head") and tag not in HEAD and tag != "head":
            self.cut(self.open["head"][-1])
        if tag not in INLINE:
            n = self.tags
            self.end_line()
            self.tags = 1 if n else 0
            self.close_before(tag)
        top = self.stack[-1] if self.stack else 0
        own = tag in ("article", "main") or ("role", "main") in attrs
        dull = mark(tag, attrs, self.in_main[top])
        if dull and tag in INLINE and tag != "a":
            self.end_line()
        place, number = len(self.stack), len(self.tag)
        self.tag.append(tag)
        self.parent.append(top)
        self.marks.append(dull)
        self.mains.append(own)
        self.in_main.append(own or self.in_main[top])
        self.stack.append(number)
        self.open.setdefault(tag, []).append(place)
        if tag not in INLINE:
            self.blocks.append(place)
            if tag not in ("p", "td", "th"):
                self.walls.append(place)

    def parse_comment(self, i: int, report: int = 1) -> int:
        """The end of a comment; one that is never closed goes to the end of the page, so each is searched once."""
        close = self.rawdata.find("-->", i + 2)  # <!--> is a whole comment
        return close + 3 if close >= 0 else len(self.rawdata)

    def parse_html_declaration(self, i: int) -> int:
        """The end of a declaration, likewise."""
        if self.rawdata.startswith("<!--", i):
            return self.parse_comment(i)
        close = self.rawdata.find(">", i)
        return close + 1 if close >= 0 else len(self.rawdata)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # a slash means nothing on elements that are not void

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        inline = tag in INLINE
        if not inline and tag != "br":
            self.end_line()
        places = self.open.get(tag)
        if not places or inline and self.blocks and places[-1] < self.blocks[-1]:
            return
        if inline and self.marks[self.stack[places[-1]]] and tag != "a":
            self.end_line()
        self.cut(places[-1])

    def handle_data(self, data: str) -> None:
        if self.stack and self.tag[self.stack[-1]] in SILENT:
            return
        self.parts.append(data)
        if self.open.get("a"):
            self.linked += len(data.strip())


def smooth(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing with reflected ends."""
    r = int(3 * sigma) or 1
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    padded = np.pad(x, r, mode="reflect" if len(x) > r else "edge")
    return np.convolve(padded, k / k.sum(), mode="valid")


def _held(p: Lines, weight: list[int], lines: list[int]) -> list[int]:
    """What each element and all in it hold of the lines' weights."""
    out = [0] * len(p.tag)
    for n in lines:
        out[p.at[n]] += weight[n]
    for i in range(len(out) - 1, 0, -1):
        out[p.parent[i]] += out[i]
    return out


def _dull(p: Lines, size: list[int], last: list[int]) -> list[int]:
    """Mark of each element with those it inherits; wrappers that hold the page's content count as content."""
    hard = [0] * len(p.tag)
    for i in range(1, len(hard)):
        hard[i] = hard[p.parent[i]] or int(p.marks[i] == 2)
    if any(m == 1 for m in p.marks):
        lines = [n for n in range(len(p.text)) if not hard[p.at[n]]]
        held = _held(p, size, lines)
        told = _held(p, size, [n for n in lines if p.tag[p.block[n]] in PARAGRAPHS])
        mains = [i for i, m in enumerate(p.mains) if m and not hard[i] and held[i]]
        low, high = (max(mains), min(last[i] for i in mains)) if mains else (0, len(p.tag))
        for i, m in enumerate(p.marks):
            if m == 1 and not hard[i]:
                # a form inside every article there is, or in a page without one
                form = p.tag[i] in FORMS and low <= i <= high and 2 * held[i] > held[0] and 2 * told[i] > held[i]
                if form or not mains and held[i] >= WRAPS * held[0]:
                    p.marks[i] = 0
    out = [0] * len(p.tag)
    for i in range(1, len(out)):
        above = out[p.parent[i]]
        # an article stands out from a wrapper that merely names a side part
        out[i] = max(0 if p.mains[i] and above == 1 else above, p.marks[i])
    return out


def _in_mains(p: Lines, mains: list[int], held: list[int], last: list[int], good: list[int], size: list[int], cluster: set[int]) -> list[int]:
    """Lines of the main element, or of the articles side by side that weigh alike."""
    best = max(mains, key=lambda m: (held[m], -m))
    peers = [m for m in mains if m == best or (m > last[best] or last[m] < best) and 3 * held[m] >= held[best]]
    if len(peers) == 1:
        peers = [min(m for m in mains if m <= best <= last[m])]
    inside = [False] * len(p.tag)
    for m in peers:
        inside[m] = True
    for i in range(1, len(inside)):
        inside[i] = inside[i] or inside[p.parent[i]]
    own = [n for n in good if inside[p.at[n]]]
    dense = [n for n in own if n in cluster]
    between = range(dense[0], dense[-1] + 1) if dense else range(0)
    chosen = [n for n in own if p.tag[p.block[n]] in PARAGRAPHS or (n in cluster or n in between) and p.links[n] <= 0.5 * size[n]]
    if not any(p.tag[p.block[n]] == "h1" for n in chosen):
        first = min(peers)
        before = [n for n in good if p.tag[p.block[n]] == "h1" and p.block[n] < first and p.parent[p.block[n]] <= first <= last[p.parent[p.block[n]]]]
        chosen = [n for n in before if p.block[n] == p.block[before[-1]]] + chosen
    return chosen


def _around(p: Lines, cluster: list[int], last: list[int], good: list[int], size: list[int]) -> list[int]:
    """Lines of the deepest element that holds most of the cluster."""
    held = _held(p, size, cluster)
    top = max(i for i, h in enumerate(held) if 2 * h > held[0])  # such elements are nested, the last is the deepest
    while top and (p.tag[top] in INLINE or p.tag[top] in PARAGRAPHS):
        top = p.parent[top]
    low, high = cluster[0], cluster[-1]
    out = []
    for n in good:
        if top <= p.at[n] <= last[top]:
            tag = p.tag[p.block[n]]
            if tag in HEADINGS or p.links[n] <= 0.5 * size[n] and (low <= n <= high or tag in PARAGRAPHS):
                out.append(n)
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    p = Lines()
    end = html.rfind(">") + 1
    p.feed(html[:end])
    p.close()
    if not p.cdata_elem and "<!--" not in html[end:]:
        p.handle_data(unescape(html[end:]))  # no tag ends here, so all of it is text
    p.end_line()
    last = list(range(len(p.tag)))  # the last element inside each
    for i in range(len(last) - 1, 0, -1):
        last[p.parent[i]] = max(last[p.parent[i]], last[i])
    size = [len(t) for t in p.text]
    dull = _dull(p, size, last)
    good = [n for n in range(len(p.text)) if not dull[p.at[n]]]
    if not good:
        return ""
    ratio = smooth(np.array([p.ratio[n] for n in good]))
    above = ratio >= min(ratio.std(), ratio.max()) if len(good) > 1 else [True]
    cluster = [n for n, a in zip(good, above) if a]
    held = _held(p, size, cluster)
    mains = [i for i, m in enumerate(p.mains) if m and not dull[i] and held[i]]
    chosen = _in_mains(p, mains, held, last, good, size, set(cluster)) if mains else _around(p, cluster, last, good, size)
    return " ".join([p.text[n] for n in chosen])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages``."""

    def one(b: pa.RecordBatch) -> dict:
        texts = [main_text(h) for h in b.column(2).to_pylist()]
        return {"page_id": b.column(0), "url": b.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

    return map_batches(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), "page_id long, url string, text string, n_chars long", one)
