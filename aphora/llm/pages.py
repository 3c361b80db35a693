"""Main text of web pages by removal of site templates.

Every page is read into a tree of elements. A subtree's hash covers its tags and its text; Spark counts for every host in
how many different surroundings (parents) a hash occurs, so that copies of a page count once. Subtrees that recur across
many pages of a host are its template, and are deleted, but never one that holds an article; those that are not on most
pages of a busy host stay where they would be most of a page's own text. Inside an article or main element, where pages of one site may well share a paragraph, a
subtree must stand on most pages of a busy host to count as template; around it a few pages suffice. What is never
main text by its kind (scripts, styles, forms, menus, headers, footers, sidebars, notices, adverts, reader comments, told by
element, role, class or id) goes as well. If a page has article or main elements, its text is what they hold.

Character references are decoded; white space inside a block becomes one space; blocks are joined by an empty line. A null
or empty page has an empty text. A null url is a host of its own name (empty). Broken markup never fails: unknown ends
are skipped, open elements end with their parents. Repeated rows are returned each. An empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aphora.llm.tables import stored

#: A subtree outside of articles is template from so many different pages of its host on, and so large a share of them
#: or so many that the share does not matter.
MIN_PAGES, MIN_SHARE, MANY_PAGES = 3, 0.01, 100
#: The same inside of articles; outside of them, what goes whatever share of a page's text it is.
MIN_PAGES_INSIDE, MIN_SHARE_INSIDE = 20, 0.5
#: Largest number of template subtrees shown on pages (about twenty bytes each) that is broadcast.
BROADCAST_HASHES = 200_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>"
    r"|[^<]+|<", re.S)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*))?")
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_BLANKS = re.compile(r"\s+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes svg math".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
_DROPPED = frozenset(
    "head script style noscript template textarea title iframe svg math nav header footer aside form button select option input object embed canvas audio video map dialog menu".split())
_MAIN = frozenset(("article", "main"))
# What an opening tag ends first: an element of the same kind that is still open, up to the nearest of the borders.
_ENDS = {t: (frozenset(ends.split()), frozenset(borders.split())) for t, ends, borders in (
    ("li", "li p", "ul ol"), ("dt", "dt dd p", "dl"), ("dd", "dt dd p", "dl"), ("tr", "tr td th p", "table"), ("td", "td th p", "tr table"), ("th", "td th p", "tr table"),
    ("option", "option", "select"), ("tbody", "tr td th tbody thead p", "table"), ("body", "head", "html"))}
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_NOT_MAIN_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus disclaimer footer gdpr header masthead "
    "menu menubar modal nav navbar navigation newsletter notice notices notification overlay pagination pager popup promo promoted promotion recommended related replies reply respond share sharing "
    "sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split())
#: Words of a class after which others say what an element has or how it is laid out.
_STATES = frozenset("no not has have is with without layout hide show".split())
#: Words at the end of a name that say where or how large an element is; the word before them says what it is.
_PLACES = frozenset("left right top bottom upper lower area bar block box container content div holder inner item items link links list outer panel region section wrap wrapper zone".split())
_NOT_MAIN_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())


HARD, WHOLE, PART = 1, 2, 3


def _not_main(attrs: str) -> int:
    """How attributes mark an element as something besides the main text, 0 if not at all.

    ``HARD`` by role or visibility; ``WHOLE`` by a class or id that is such a word; ``PART`` by one that ends in it, words of
    place aside, as ``main-menu`` and ``sidebar-right`` do. So a word counts only as what the element is: neither a
    ``cookie-recipe`` is meant nor, after a word that says what it has or how it is laid out, a ``no-sidebar``.
    """
    out = 0
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            for token in value.split():
                if token in _NOT_MAIN_WORDS:
                    out = WHOLE
                    continue
                words = [w for w in _SPLIT.split(token) if w]
                while len(words) > 1 and (words[-1] in _PLACES or words[-1].isdigit()):
                    words.pop()
                if words and words[-1] in _NOT_MAIN_WORDS and not _STATES.intersection(words):
                    out = out or PART
        elif name == "role":
            if value in _NOT_MAIN_ROLES:
                return HARD
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return HARD
    return out


class Page:
    """Elements of a page in order of their start, each with its parent, and the text runs between tags."""

    def __init__(self, source: str | None) -> None:
        self.tags, self.parents, self.dropped, self.last = ["#"], [-1], [False], [0]
        self.runs: list[tuple[int, int, str]] = []  # element, elements started so far, text
        self.digests: dict[int, int] = {}  # filled by hashes(), of every element that does not go by its kind
        self.named: dict[int, int] = {}  # elements that go by class or id, WHOLE or PART
        self._read(source or "")
        if self.named:
            self._spare()

    def _read(self, source: str) -> None:
        stack, names, raw = [0], ["#"], None
        opened: Counter = Counter()  # open elements by tag, so that no search is made for one that is not there

        def close(depth: int) -> None:
            for at, name in zip(stack[depth:], names[depth:]):
                self.last[at] = len(self.tags)
                opened[name] -= 1
            del stack[depth:], names[depth:]

        def close_last(tag: str) -> None:
            depth = len(names) - 1
            while names[depth] != tag:
                depth -= 1
            close(depth)

        for m in _TOKEN.finditer(source):
            tag = m["tag"]
            if tag is None:
                token = m[0]
                if raw is None and (token[0] != "<" or token == "<"):
                    self.runs.append((stack[-1], len(self.tags), token))
                continue
            tag = tag.lower()
            if raw is not None:
                # Only the matching end counts inside a script or style.
                if m["end"] and tag == raw:
                    raw = None
                    close(len(stack) - 1)
                continue
            if m["end"]:
                if opened[tag]:
                    close_last(tag)
                elif tag == "br":
                    self.runs.append((stack[-1], len(self.tags), " "))
                continue
            if tag in _ENDS_P and opened["p"]:
                close_last("p")
            if tag in _ENDS:
                ends, borders = _ENDS[tag]
                depth = len(names)
                while depth > 1 and names[depth - 1] not in borders and any(opened[t] for t in ends if t != "p"):
                    depth -= 1
                    if names[depth] in ends and names[depth] != "p":
                        close(depth)
            if tag == "br":
                self.runs.append((stack[-1], len(self.tags), " "))
                continue
            at = len(self.tags)
            self.tags.append(tag)
            self.parents.append(stack[-1])
            told = _not_main(m["attrs"]) if m["attrs"] and tag not in _DROPPED and tag not in ("html", "body") else 0
            self.dropped.append(tag in _DROPPED or told > 0)
            if told in (WHOLE, PART):
                self.named[at] = told
            self.last.append(at + 1)
            if tag in _VOID or m["attrs"].endswith("/") and tag in _RAW:
                continue
            stack.append(at)
            names.append(tag)
            opened[tag] += 1
            if tag in _RAW:
                raw = tag
        close(0)

    def amounts(self, kept: list[bool]) -> list[int]:
        """Characters of text in every element, as far as the elements are kept."""
        out = [0] * len(self.tags)
        for element, _, text in self.runs:
            if kept[element]:
                out[element] += len("".join(text.split()))
        for at in range(len(self.tags) - 1, 0, -1):
            out[self.parents[at]] += out[at]
        return out

    def _spare(self) -> None:
        """Keep elements told by class or id that hold all the articles, or (without an article elsewhere) the page's text.

        A word within a longer name does not drop what holds most of the text; a name that is the word itself, all of it.
        """
        size = len(self.tags)
        solid, mains, around = [True] * size, [0] * size, [0] * size
        for at in range(1, size):
            parent = self.parents[at]
            solid[at] = solid[parent] and (not self.dropped[at] or at in self.named)
            around[at] = around[parent] + (self.tags[at] in _MAIN and solid[at] and at not in self.named)
        for at in range(size - 1, 0, -1):
            mains[self.parents[at]] += mains[at] + (self.tags[at] in _MAIN and solid[at] and at not in self.named)
        amounts = self.amounts(solid)
        for at, told in self.named.items():
            if mains[at] + around[at] == mains[0]:
                text = 2 * amounts[at] > amounts[0] if told == PART else 0 < amounts[at] == amounts[0]
                self.dropped[at] = not (mains[at] or text)

    def hashes(self) -> list[int]:
        """For every block element with text: a hash of its tags and text; 0 for others. What goes by its kind counts as absent.

        The first entry, that of the page, is always set: pages of one hash are copies.
        """
        own: list[list[str]] = [[t] for t in self.tags]
        inner: list[list[int]] = [[] for _ in self.tags]  # digests of children, the last one first
        for element, _, text in self.runs:
            text = _BLANKS.sub(" ", text).strip()
            if text:
                own[element].append(text)
        out = [0] * len(self.tags)
        filled = [False] * len(self.tags)
        for at in range(len(self.tags) - 1, 0, -1):
            if self.dropped[at]:
                continue
            parent = self.parents[at]
            has_text = filled[at] or len(own[at]) > 1
            self.digests[at] = digest = _digest([own[at][0], *reversed(inner[at]), *own[at][1:]])
            inner[parent].append(digest)
            if has_text:
                filled[parent] = True
                if self.tags[at] not in _INLINE:
                    out[at] = digest
        self.digests[0] = out[0] = _digest([own[0][0], *reversed(inner[0]), *own[0][1:]])
        return out

    def kept(self) -> list[bool]:
        """Whether neither the element nor any around it goes by its kind."""
        out = [True] * len(self.tags)
        for at in range(1, len(self.tags)):
            out[at] = out[self.parents[at]] and not self.dropped[at]
        return out

    def inside(self) -> list[bool]:
        """Whether each element is, or stands in, an article or main element that is not itself dropped."""
        out, kept = [False] * len(self.tags), self.kept()
        for at in range(1, len(self.tags)):
            out[at] = out[self.parents[at]] or self.tags[at] in _MAIN and kept[at]
        return out

    def _without(self, template: frozenset[int], template_inside: frozenset[int], hashes: list[int], inside: list[bool], holds: list[bool]) -> list[bool]:
        keep = [True] * len(self.tags)
        for at in range(1, len(self.tags)):
            deleted = bool(hashes[at]) and hashes[at] in (template_inside if inside[at] else template) and self.tags[at] not in ("html", "body") and not holds[at]
            keep[at] = keep[self.parents[at]] and not self.dropped[at] and not deleted
        return keep

    def text(self, template: frozenset[int], template_inside: frozenset[int], doubtful: frozenset[int] = frozenset()) -> str:
        """Blocks of the main text. The sets hold the hashes of template subtrees around and inside articles; those of the
        first that are ``doubtful`` go only if together they are no more than half of the text without the others."""
        inside = self.inside()
        only = any(inside)
        hashes = self.hashes() if template or template_inside else [0] * len(self.tags)
        # An article, and what holds one, is never deleted as a whole.
        holds = [x and t in _MAIN for x, t in zip(inside, self.tags)]
        for at in range(len(self.tags) - 1, 0, -1):
            holds[self.parents[at]] = holds[self.parents[at]] or holds[at]
        keep = self._without(template, template_inside, hashes, inside, holds)
        if template & doubtful:
            own = self._without(template - doubtful, template_inside, hashes, inside, holds)
            if 2 * self.amounts(keep)[0] < self.amounts(own)[0]:
                keep = own
        block = [0] * len(self.tags)
        for at in range(1, len(self.tags)):
            block[at] = block[self.parents[at]] if self.tags[at] in _INLINE else at
        blocks: list[str] = []
        parts: list[str] = []
        now = (-1, 0)

        def flush() -> None:
            joined = _BLANKS.sub(" ", html.unescape("".join(parts))).strip()
            if joined:
                blocks.append(joined)
            parts.clear()

        blocks_before = np.cumsum([t not in _INLINE for t in self.tags]).tolist()
        for element, started, text in self.runs:
            # A new block begins when the enclosing block changes, or a block element started in between.
            here = (block[element], blocks_before[started - 1])
            if here != now:
                flush()
                now = here
            if keep[element] and (inside[element] or not only):
                parts.append(text)
        flush()
        return "\n\n".join(blocks)


def _digest(parts: list) -> int:
    from hashlib import blake2b

    return int.from_bytes(blake2b("\x1f".join([str(p) for p in parts]).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def subtrees(pages: DataFrame) -> DataFrame:
    """(row, host, inside, shown, hash, around): the distinct block subtrees of each page, and hash 0 for the page itself.

    ``around`` is the hash of the parent, and for the page that of all of it. Subtrees that go by their kind are left out. ``shown`` marks those that would be text of the page: all of them, or
    those inside of articles if it has any.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                rows, insides, shown, hashes, around = [], [], [], [], []
                for i, source in enumerate(part["html"].to_pylist()):
                    page = Page(source)
                    inside, kept = page.inside(), page.kept()
                    only = any(inside)
                    own = page.hashes()
                    found = {(False, 0): own[0]}
                    for at in range(1, len(own)):
                        if own[at] and kept[at]:
                            found.setdefault((inside[at], own[at]), page.digests[page.parents[at]])
                    rows += [i] * len(found)
                    insides += [x for x, _ in found]
                    shown += [h != 0 and (x or not only) for x, h in found]
                    hashes += [h for _, h in found]
                    around += found.values()
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part["row"].take(at), part["host"].take(at), pa.array(insides, pa.bool_()), pa.array(shown, pa.bool_()), pa.array(hashes, pa.int64()), pa.array(around, pa.int64())],
                    ["row", "host", "inside", "shown", "hash", "around"])

    return pages.mapInArrow(read, "row bigint, host string, inside boolean, shown boolean, hash bigint, around bigint")


def templates(found: DataFrame) -> DataFrame:
    """(host, inside, hash, sure) of the subtrees that recur across many different pages of their host.

    What counts is in how many surroundings a subtree stands: copies of a page are one, and a part of a recurring subtree
    has no count of its own. ``sure`` are those on most pages of a busy host.
    """
    pages = found.where("hash = 0").groupBy("host").agg(F.count_distinct("around").alias("pages"))
    counts = found.where("hash <> 0").groupBy("host", "inside", "hash").agg(F.count_distinct("around").alias("n")).where(F.col("n") >= min(MIN_PAGES, MIN_PAGES_INSIDE))
    many = F.least(F.lit(float(MANY_PAGES)), MIN_SHARE * F.col("pages"))
    around = ~F.col("inside") & (F.col("n") >= MIN_PAGES) & (F.col("n") >= many)
    sure = (F.col("n") >= MIN_PAGES_INSIDE) & (F.col("n") >= MIN_SHARE_INSIDE * F.col("pages"))
    return counts.join(pages, "host").where(around | F.col("inside") & sure).select("host", "inside", "hash", sure.alias("sure"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of (page_id, url, html)."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    source = pages.select(F.xxhash64("page_id", "url", "html").alias("row"), "page_id", "url", "html", host.alias("host"))
    found = stored(subtrees(source), "subtrees")
    # The template's table is one of its own, so that the join may split a hot host.
    known = stored(templates(found), "templates")
    hits = stored(found.where("shown").join(known, ["host", "inside", "hash"]).groupBy("row").agg(F.collect_set(F.struct("inside", "hash", "sure")).alias("known")), "hits")
    # Most pages show none. The lists go to every executor if they are few; otherwise pages and lists are shuffled.
    size = hits.agg(F.sum(F.size("known"))).first()[0] or 0
    hits = F.broadcast(hits) if size <= BROADCAST_HASHES else hits

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for source_, known in zip(batch["html"].to_pylist(), batch["known"].to_pylist()):
                known = known or []
                texts.append(Page(source_).text(frozenset(k["hash"] for k in known if not k["inside"]), frozenset(k["hash"] for k in known if k["inside"]),
                                               frozenset(k["hash"] for k in known if not k["inside"] and not k["sure"])))
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    joined = source.join(hits, "row", "left").select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html", "known")
    return joined.mapInArrow(extract, "page_id bigint, url string, text string, n_chars bigint")
