"""Operator 4. HTML extraction with site template removal.

Pages are parsed into elements; inline elements belong to the text around them. Every subtree outside an article is hashed
twice: by its source, and by its shape, which is the tags, classes and ids from the root to it and of the elements in it,
without any text. In Spark, hashes are counted per host, and what recurs on many pages of a host is deleted from them:

  by source  a subtree that stands in as many different parents as a template must. A template stands in a different page
             each time, while what is inside a copied part always has the same parent.
  by shape   a container without headings whose shape stands on as many different pages, and that holds a small share of
             the text of the host's pages: menus, adverts and footers whose words change from page to page.

That is many pages if they are at least `share` of the host's different pages, and at least `least`. Prose inside an article
element is left alone: copies and quotations recur too, and only a template's place outside the article, or its links, tell
it from them. On a page without an article what is in main counts like the rest of the body, but for its shape.

What recurrence doesn't decide, as on a host of few pages, meaning does: scripts, styles, forms, menus, asides, footers, headers
outside the article, hidden elements, and those whose class, id or role names adverts, notices, comments and the like go.
What is left of the article elements is the text; without any, of main; without that, of the body. With `meaning` off, only
recurrence decides, and of the list only what holds no text of the page, such as scripts, goes.

Character references are decoded, white space inside a block becomes one blank, blocks are trimmed, empty ones left out,
and the others joined by line feeds in page order. br is white space.

Defined results: a null page is empty; an empty page, and one without text, gives an empty text. A null url, or one
without "://", has the empty host, whose pages are a site like others. Repeated rows give repeated rows; columns other
than id, url and html are not read. An empty table gives an empty table. The set of recurring subtrees is broadcast only
if it has at most `broadcast_rows` rows; a larger one is joined to the pages it concerns.
"""

from __future__ import annotations

import hashlib
import re
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, written
from .url_filter import address

#: Pages of a template: at least so many, and at least this share of a host's different pages; the largest share of a host's
#: text in elements that go by their shape; rows of (host, hash) that may be broadcast: some 20 MB.
LEAST_PAGES, SHARE, TEXT_SHARE, BROADCAST_ROWS = 3, 0.05, 0.05, 200_000

#: Elements of HTML by their meaning.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
TEXTLESS = frozenset("head title script style noscript template iframe object svg canvas audio video map noembed noframes select option textarea button".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp".split())
OUT = frozenset("head script style title noscript template iframe object svg canvas nav footer aside form input button select textarea label fieldset dialog menu audio video map".split())
CLOSES = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
SCOPES = frozenset("ul ol dl table tbody thead tfoot select article section main div body".split())
#: Words in class, id and role that name what is no article.
NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead banner footer sidebar aside complementary contentinfo"
    " ad ads advert adverts advertisement advertising sponsor sponsored promo promotion"
    " notice notices cookie cookies consent gdpr popup modal overlay alert subscribe newsletter signup login search"
    " comment comments disqus replies share sharing social related recommended pagination pager toolbar widget".split()
)

TAG = re.compile(r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*+>?|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|[^>]*+>?))""", re.S)
ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?""")
SPLIT = re.compile(r"[^a-z]+")
LAYOUT = frozenset(["html", "body", "main", "article"])
#: Elements that hold other blocks, and headings.
CONTAINERS = frozenset("nav header footer aside div section ul ol dl table form fieldset details figure menu address center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Element(NamedTuple):
    tag: str
    start: int
    parent: int
    out: bool
    """No article by its meaning, or inside such an element."""
    article: bool
    main: bool
    name: str
    """The tag with its classes and id."""


class Page:
    """Elements that aren't inline, their ends, and the blocks of text with the element they stand in."""

    def __init__(self, html: str):
        self.html = html
        self.elements = [Element("", 0, -1, False, False, False, "")]
        self.ends = [len(html)]
        self.links = [0]
        self.chars = [0]
        self.blocks: list[tuple[int, str]] = []
        self.text: list[str] = []
        stack, pos, n = [0], 0, len(html)
        find = TAG.search
        while pos < n:
            m = find(html, pos)
            if m is None:
                self.add(html[pos:], stack[-1])
                break
            if m.start() > pos:
                self.add(html[pos : m.start()], stack[-1])
            pos = m.end()
            close, tag, attributes = m.groups()
            if tag is None:
                continue
            tag = tag.lower()
            if close:
                if tag in INLINE and self.elements[stack[-1]].tag != tag:
                    continue
                if any(self.elements[i].tag == tag for i in stack[1:]):
                    self.flush(stack[-1])
                    while True:
                        i = stack.pop()
                        self.ends[i] = pos if self.elements[i].tag == tag else m.start()
                        if self.elements[i].tag == tag:
                            break
                continue
            out, name = tag in OUT, tag
            if attributes:
                named, words = described(tag, attributes)
                out, name = out or named, f"{tag}.{words}" if words else tag
            if tag in INLINE and not out:
                if tag == "br":
                    self.text.append(" ")
                elif tag == "a":
                    self.links[stack[-1]] += 1
                continue
            if tag in VOID:
                if tag == "hr":
                    self.flush(stack[-1])
                continue
            self.flush(stack[-1])
            closing = CLOSES.get(tag)
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    at = self.elements[stack[k]].tag
                    if at in closing:
                        for i in stack[k:]:
                            self.ends[i] = m.start()
                        del stack[k:]
                    elif at in SCOPES:
                        break
            elif self.elements[stack[-1]].tag == "p" and tag not in INLINE:
                self.ends[stack.pop()] = m.start()
            above = self.elements[stack[-1]]
            if tag == "header" and not (above.article or above.main):
                out = True
            self.elements.append(Element(tag, m.start(), stack[-1], out or above.out, tag == "article" or above.article, tag == "main" or above.main, name))
            self.ends.append(n)
            self.links.append(0)
            self.chars.append(0)
            stack.append(len(self.elements) - 1)
            if tag in RAW:
                end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, pos)
                pos = end.start() if end else n
        self.flush(stack[-1])

    def add(self, raw: str, at: int) -> None:
        if self.elements[at].tag not in TEXTLESS:
            self.text.append(unescape(raw) if "&" in raw else raw)
            self.chars[at] += len(raw) if raw.strip() else 0

    def flush(self, at: int) -> None:
        if self.text:
            block = " ".join("".join(self.text).split())
            if block:
                self.blocks.append((at, block))
            self.text = []

    def gathered(self, own: list[int]) -> list[int]:
        """Sums over each element and all in it."""
        sums = own.copy()
        for i in range(len(self.elements) - 1, 0, -1):
            sums[self.elements[i].parent] += sums[i]
        return sums

    def candidates(self) -> list[int]:
        """Elements that may go by their source: outside articles, or made of links rather than prose."""
        if not any(e.article and not e.out for e in self.elements):
            return [i for i, e in enumerate(self.elements) if e.tag not in LAYOUT and e.tag not in ("", "head")]
        links, chars = self.gathered(self.links), self.gathered(self.chars)
        inside = lambda e: e.tag in LAYOUT or e.tag == "" or e.tag == "head" or ((e.article or e.main) and not e.out)
        return [i for i, e in enumerate(self.elements) if not inside(e) or (e.tag not in LAYOUT and e.tag not in ("", "head") and links[i] > 1 and chars[i] < 40 * links[i])]

    def keys(self) -> list[int]:
        """A hash of each element's source, white space as single blanks: of its own source, with hashes for the elements in it."""
        parts: list[list[str]] = [[] for _ in self.elements]  # from the end
        at = self.ends.copy()
        out = [0] * len(self.elements)
        for i in range(len(self.elements) - 1, -1, -1):
            start = self.elements[i].start
            parts[i].append(" ".join(self.html[start : at[i]].split()))
            out[i] = digest("\0".join(reversed(parts[i])))
            parts[i] = []
            if i:
                above = self.elements[i].parent
                parts[above] += [" ".join(self.html[self.ends[i] : at[above]].split()), str(out[i])]
                at[above] = start
        return out

    def shapes(self) -> dict[int, int]:
        """Elements that may go by their shape, and its hash: of the names from the root to it, and of those in it."""
        names: list[set[str]] = [set() for _ in self.elements]
        for i in range(len(self.elements) - 1, 0, -1):
            names[self.elements[i].parent] |= names[i] | {self.elements[i].name}
        place = [0] * len(self.elements)
        out = {}
        for i, e in enumerate(self.elements[1:], 1):
            place[i] = digest(f"{place[e.parent]} {e.name}")
            if e.tag in CONTAINERS and not (e.article or e.main) and not any(n.split(".")[0] in HEADINGS | LAYOUT for n in names[i]):
                out[i] = digest(f"shape {place[i]} {' '.join(sorted(names[i]))}")
        return out

    def subtrees(self) -> dict[tuple[int, int], int]:
        """{(hash, parent's hash): characters}. A shape has no parent, which 0 stands for; so has the page, whose hash is 0."""
        keys, chars = self.keys(), self.gathered(self.chars)
        out = {(keys[i], keys[self.elements[i].parent]): 0 for i in self.candidates()}
        for i, shape in self.shapes().items():
            out[shape, 0] = out.get((shape, 0), 0) + chars[i]
        out[0, 0] = chars[0]
        return out

    def decided(self, recurring: set[int] | frozenset[int]) -> list[bool]:
        """Whether each element goes by recurrence, or is in one that does."""
        gone = [False] * len(self.elements)
        if recurring:
            keys, shapes = self.keys(), self.shapes()
            for i in self.candidates():
                gone[i] = keys[i] in recurring
            for i, shape in shapes.items():
                gone[i] = gone[i] or shape in recurring
            for i, e in enumerate(self.elements[1:], 1):  # parents stand before their children
                gone[i] = gone[i] or gone[e.parent]
        return gone

    def main_text(self, recurring: set[int] | frozenset[int], meaning: bool = True) -> str:
        gone = self.decided(recurring)
        left = [(self.elements[i], text) for i, text in self.blocks if not gone[i] and not (meaning and self.elements[i].out)]
        for part in ([t for e, t in left if e.article and meaning], [t for e, t in left if e.main and meaning], [t for e, t in left]):
            if part:
                return "\n".join(part)
        return ""

    def removed(self, recurring: set[int] | frozenset[int]) -> tuple[int, int]:
        """Blocks of text that go by recurrence, and those that only meaning removes."""
        gone, text = self.decided(recurring), {e for e in ("article", "main") if any(getattr(self.elements[i], e) and not self.elements[i].out for i, _ in self.blocks)}
        meant = [e.out or bool(text) and not getattr(e, min(text)) for e in self.elements]
        return sum(gone[i] for i, _ in self.blocks), sum(meant[i] and not gone[i] for i, _ in self.blocks)


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def described(tag: str, attributes: str) -> tuple[bool, str]:
    """Whether class, id, role or visibility say that an element is no article; and its classes and id."""
    out, names = False, []
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            out = True
        if name in ("class", "id", "role"):
            out = out or bool(set(SPLIT.split(value)) & ({"comment", "comments"} if tag in LAYOUT else NAMES))
            names += value.split()
    return out, ".".join(sorted(names))


def recurring_subtrees(rows: DataFrame, least: int, share: float, text_share: float) -> tuple[DataFrame, DataFrame]:
    """(host, page, key) of all subtrees of pages (host, html, page), and (host, key) of those that recur."""

    def parsed(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: tuple[list, ...] = ([], [], [], [], [])
        for host, html, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            for (key, parent), chars in Page(html).subtrees().items():
                for column, value in zip(out, (host, page, key, parent, chars), strict=True):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), *[pa.array(x, pa.int64()) for x in out[1:]]], ["host", "page", "key", "parent", "chars"])

    found = written(map_batches(rows.select("host", "html", "page"), parsed, "host string, page long, key long, parent long, chars long"), "subtrees")
    # By source: different parents. By shape, and of the host itself: different pages.
    sources = found.filter("parent != 0").select("host", "key", "parent").distinct().groupBy("host", "key").agg(F.count("*").alias("n"), F.lit(None).cast("long").alias("chars"))
    shapes = found.filter("parent = 0").select("host", "key", "page", "chars").distinct().groupBy("host", "key").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    hosts = shapes.filter("key = 0").select("host", F.col("n").alias("pages"), F.col("chars").alias("host_chars"))
    many = F.col("n") >= F.greatest(F.lit(least), F.lit(share) * F.col("pages"))
    little = F.col("chars").isNull() | (F.col("chars") <= text_share * F.col("host_chars"))
    counts = sources.filter(F.col("n") >= least).unionByName(shapes.filter((F.col("key") != 0) & (F.col("n") >= least)))
    return found.select("host", "page", "key"), written(counts.join(hosts, "host").filter(many & little).select("host", "key"), "recurring-subtrees")


def extract(pages: DataFrame, least: int = LEAST_PAGES, share: float = SHARE, text_share: float = TEXT_SHARE, meaning: bool = True, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    host, _ = address(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    page = F.xxhash64("host", "html")
    found, recurring = recurring_subtrees(rows.select("host", "html", page.alias("page")), least, share, text_share)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    schema = f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"

    def result(batch: pa.RecordBatch, sets: list) -> pa.RecordBatch:
        texts = [Page(html).main_text(gone, meaning) for html, gone in zip(batch.column(3).to_pylist(), sets, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    if recurring.count() <= broadcast_rows:
        by_host: dict[str, set[int]] = {}
        for r in recurring.collect():
            by_host.setdefault(r.host, set()).add(r.key)
        sent = pages.sparkSession.sparkContext.broadcast(by_host)
        return map_batches(rows, lambda batch: result(batch, [sent.value.get(h, frozenset()) for h in batch.column(2).to_pylist()]), schema)
    own = found.select("host", "page", "key").distinct().join(recurring, ["host", "key"]).groupBy("page").agg(F.collect_set("key").alias("keys"))
    joined = rows.withColumn("page", page).join(own, "page", "left").select("page_id", "url", "host", "html", "keys")
    return map_batches(joined, lambda batch: result(batch, [set(k or ()) for k in batch.column(4).to_pylist()]), schema)
