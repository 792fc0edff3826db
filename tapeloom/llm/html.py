"""Main text of web pages by two passes of block rules.

The markup is read once into blocks: text between block-level tags, with its link characters and the parts of the page it
lies in. First pass: blocks inside navigation, headers, footers, sidebars, forms, notices, adverts, comments and hidden
parts are bad; the rest is judged by link density, length and, where the page uses the common words of a listed language at
all, the density of stop words. Where an article or main part holds most of that text, what stands outside is bad. Few stop words leave a block open, as tables and code have few. Second pass: blocks left open
take the label of the nearest decided blocks; where both sides disagree, the nearer one decides, and where the page has no
block that is known as good, they are kept. Headings go with what they
head. All text of good blocks is kept, whatever its length.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .workers import in_arrow, parts

#: fixed values: element names of the HTML standard
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main menu meta nav ol option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
DROPPED = frozenset("script style xmp iframe noembed noframes noscript head title template nav header footer aside form button select option textarea svg canvas object applet math audio video dialog menu search".split())
MAIN = frozenset(["article", "main"])
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: fixed values: words of class, id and role that name what isn't the article
PARTS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer discussion footer gdpr header menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related reply replies respond search share sharing sidebar skip social sponsor sponsored subscribe toolbar widget masthead alert complementary contentinfo paywall feedback".split()
)
#: fixed values: words that stand beside those without changing what they name
BESIDE = frozenset("area bar block bottom box container inner left link links list right section site top wrap wrapper".split())
#: fixed values: common words of the languages read
STOP = frozenset(
    "the of and to in is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their if will each about how up out them then she many some so these would other into has more two her like him see time could no make than been its who now people my made over did down only way find use may long little very after words called just where most know que de la el en y a los se del las por un para con una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto mí antes algunos qué unos yo otro otras otra él et les des du une est dans qui il sur pas au plus par je ne vous avec tout faire son mais comme ou si leur y dire elle avant deux bien même aussi celui der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum haben nur oder aber vor zur bis mehr durch man sein wurde sei".split()
)
TAG = re.compile(r"<(?:!--(?P<comment>)|(?P<decl>[!?])|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>)")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORD = re.compile(r"[^\W\d_]+")
NAME = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    links: int
    dropped: bool
    main: bool
    heading: bool
    good: bool | None = None


@dataclass
class Reader:
    """Block reader. ``open`` holds (name, dropped here, main part) of the open elements, ``at`` the places of each name in it
    and ``count`` how many are dropped, main parts or headings, so that no step depends on how deep the page is nested."""

    blocks: list[Block] = field(default_factory=list)
    open: list[tuple[str, bool, bool]] = field(default_factory=list)
    at: dict[str, list[int]] = field(default_factory=dict)
    count: dict[str, int] = field(default_factory=lambda: {"dropped": 0, "main": 0, "heading": 0})
    parts: list[str] = field(default_factory=list)
    links: int = 0

    def end_block(self) -> None:
        text = " ".join(html.unescape("".join(self.parts)).split())
        if text:
            self.blocks.append(Block(text, self.links, self.count["dropped"] > 0, self.count["main"] > 0, self.count["heading"] > 0))
        self.parts, self.links = [], 0

    def text(self, data: str) -> None:
        if data:
            self.parts.append(data)
            if self.at.get("a"):
                self.links += len(data.strip())

    def start(self, name: str, rest: str) -> None:
        if name == "br":
            self.parts.append(" ")
            return
        if name in BLOCK:
            self.end_block()
        if name in VOID:
            return
        if name in ("p", "li", "dt", "dd", "option", "tr", "td", "th") or (name in BLOCK and name != "hr"):
            self.close("p", stop=("article", "div", "section", "main", "body", "td", "li", "blockquote", "form"))
        if name in ("li", "option", "tr", "td", "th"):
            self.close(name, stop=("ul", "ol", "table", "select", "menu"))
        self.put(name, name in DROPPED or self._named(name, rest, self.count["main"] > 0), name in MAIN or 'role="main"' in rest)

    def put(self, name: str, dropped: bool, main: bool) -> None:
        self.at.setdefault(name, []).append(len(self.open))
        self.open.append((name, dropped, main))
        self._tell(name, dropped, main, 1)

    def _tell(self, name: str, dropped: bool, main: bool, by: int) -> None:
        self.count["dropped"] += by * dropped
        self.count["main"] += by * main
        self.count["heading"] += by * (name in HEADING)

    @staticmethod
    def _named(name: str, rest: str, inside: bool) -> bool:
        """Whether the attributes name a part that isn't the article; within an article an id only marks a place."""
        if not rest.strip() or name in ("html", "body", "article", "main"):
            return False
        for key, a, b, c in ATTRIBUTE.findall(rest):
            key = key.lower()
            if key in ("class", "role", "aria-label") or (key == "id" and not inside):
                value = (a or b or c).lower()
                for token in [value] if key == "aria-label" else value.split():
                    words = set(NAME.findall(token))
                    if words & PARTS and words <= PARTS | BESIDE:
                        return True
            if key == "hidden" or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a or b or c)) or (key == "aria-hidden" and (a or b or c) == "true"):
                return True
        return False

    def close(self, name: str, stop: tuple[str, ...] = ()) -> None:
        """Closes the last open element of that name and all in it, unless one of ``stop`` was opened within it."""
        if own := self.at.get(name):
            k = own[-1]
            if all(not (s := self.at.get(x)) or s[-1] <= k for x in stop):
                while len(self.open) > k:
                    gone = self.open.pop()
                    self.at[gone[0]].pop()
                    self._tell(*gone, -1)

    def end(self, name: str) -> None:
        if name == "br":
            self.parts.append(" ")
            return
        if name in BLOCK:
            self.end_block()
        self.close(name)


def blocks(page: str) -> list[Block]:
    """Blocks of a page in order; markup that is cut off at the end of the page is left out."""
    r, at, n = Reader(), 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            r.text(page[at:])
            break
        r.text(page[at:lt])
        m = TAG.match(page, lt)
        if m is None:
            if lt + 1 < n and (page[lt + 1].isascii() and page[lt + 1].isalpha() or page[lt + 1] == "/"):
                close = page.find(">", lt)  # an attribute's quote isn't closed, or the page ends within the tag
                at = n if close < 0 else close + 1
                continue
            r.text("<")
            at = lt + 1
            continue
        if m["comment"] is not None:
            end = page.find("-->", lt + 2)
            at = n if end < 0 else end + 3
            continue
        if m["decl"]:
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        name, at = m["name"].lower(), m.end()
        if m["end"]:
            r.end(name)
            continue
        if name in RAW:
            close = re.compile(rf"</{name}[\s/>]", re.IGNORECASE).search(page, at)
            body = page[at : close.start() if close else n]
            at = n if close is None else (page.find(">", close.start()) + 1 or n)
            if name not in DROPPED:
                r.text(body)
            elif name in BLOCK:
                r.end_block()
            continue
        r.start(name, m["rest"])
    r.end_block()
    return r.blocks


def label(found: list[Block], few: int = 70, low: float = 0.15, linked: float = 0.4) -> None:
    """Sets ``good`` of every block."""
    counts = [(0, 0)] * len(found)
    for i, b in enumerate(found):
        if not b.dropped:
            words = WORD.findall(b.text.lower())
            counts[i] = sum(w in STOP for w in words), len(words)
    listed = sum(k for k, _ in counts) >= low * sum(n for _, n in counts)
    told = [not b.dropped and len(b.text) >= few and b.links <= linked * len(b.text) and (not listed or c >= low * max(1, w)) for b, (c, w) in zip(found, counts)]
    inside = sum(len(b.text) for b in found if b.main and not b.dropped)
    # an article beside which more text stands is a teaser
    anchored = inside > 0 and inside >= sum(len(b.text) for b, t in zip(found, told) if t and not b.main)
    for i, b in enumerate(found):
        n = len(b.text)
        if b.dropped or (anchored and not b.main):
            b.good = False
            continue
        if b.links > linked * n and not (anchored and b.links < 0.8 * n):
            b.good = False
            continue
        b.good = True if told[i] else None
    undecided = [i for i, b in enumerate(found) if b.good is None]
    before, last = {}, None
    for i, b in enumerate(found):
        before[i] = last
        if b.good is not None:
            last = i
    after, last = {}, None
    for i in range(len(found) - 1, -1, -1):
        after[i] = last
        if found[i].good is not None:
            last = i
    decided, nothing = {}, not any(b.good for b in found)
    for i in undecided:
        left, right = before[i], after[i]
        b = found[i]
        if anchored:
            # neighbours within the same part of the page; a part without any is taken whole
            near = [found[k].good for k in (left, right) if k is not None and found[k].main and not found[k].dropped]
            decided[i] = True if not near else any(near)
            continue
        if nothing:
            decided[i] = True
            continue
        a = found[left].good if left is not None else False
        z = found[right].good if right is not None else False
        decided[i] = z if b.heading else a if a == z else (left is not None and right is not None and i - left <= right - i) == a
    for i, good in decided.items():
        found[i].good = good


def main_text(page: str | None) -> str:
    """The blocks of the article, joined by two line feeds; empty if there are none or the page is null."""
    found = blocks(page or "")
    label(found)
    return "\n\n".join(b.text for b in found if b.good)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html).

    A null or empty page has an empty text; a null url or id stays null; repeated rows give repeated rows; other columns
    are ignored; an empty table gives no rows. A very long or deeply nested page takes time in proportion to its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            texts = [main_text(h.as_py()) for h in part.column(2)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return in_arrow(chosen, run, "page_id long, url string, text string, n_chars long")
