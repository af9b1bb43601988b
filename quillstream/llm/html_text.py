"""Main text of web pages by tag-path ratios.

A page is read as a run of text blocks, each in an element with its path of tags from the root. Per path the characters
outside links and the punctuation marks are summed; a path's two ratios (characters per block, marks per block) are
given to its blocks and smoothed over the neighbouring blocks, where a neighbour counts by the likeness of its path. The
smoothed ratios are fused by their geometric mean, averaged over the path, and compared with the page's threshold. What
the page says of its parts is one more factor: paths inside a marked article weigh more, those inside an element whose
class, id or role names an advert, a menu and so on weigh less. Elements that HTML itself sets apart (nav, footer, forms
and the like) aren't candidates.

The paths that reach the threshold select the content. The deepest container below the body that holds most of their text
is the article (the whole of it where it is marked): what else stands in it (short headings, table cells, captions) belongs to it too, unless it is named
otherwise or, outside a marked article, made of links. In a marked article a word that its own parts may carry ("related-work")
names nothing: such a part is left to its ratios. Repeated children that each have an author, a date and a text are reader
comments, whatever they are called.

Reading takes linear time: a tag is found by ``find``, no pattern runs over more than a tag, and broken markup (missing end
tags, stray ones, open quotes) is repaired the way browsers do for blocks.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillstream.llm.staging import map_arrow

#: HTML's elements without an end, and those that are part of a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose text isn't shown, those whose content is no markup, and elements that never hold an article's text.
HIDDEN = frozenset("script style template noscript head title iframe object svg canvas audio video math".split())
RAW = frozenset("script style title textarea noscript iframe".split())
APART = frozenset("nav footer aside form button select textarea dialog menu input label fieldset".split())
#: Words in class, id or role that name such parts; the last ones may name an article's own head.
NAMED = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|banner|promo|promoted|sponsor(?:ed)?|cookies?|consent|notice|gdpr|popup|modal|overlay|newsletter|subscribe|signup|share|sharing|social|related|recommend(?:ed|ations)?|sidebar|side|aside|widget|nav|navbar|navigation|menu|breadcrumbs?|pager|pagination|footer|copyright|comments?|discussion|replies|respond|disqus|login|search|tags|toolbar|skip|hidden|complementary|contentinfo)(?=$|[\s_-])", re.I)
NAMED_HEAD = re.compile(r"(?:^|[\s_-])(?:header|masthead)(?=$|[\s_-])", re.I)
#: Words that a part of the article itself may carry ("related-work"); inside a marked article they only leave a part to its ratios.
NAMED_PART = re.compile(r"(?:^|[\s_-])(?:banner|notice|overlay|share|sharing|social|related|recommend(?:ed|ations)?|sidebar|side|aside|widget|discussion|search|tags|toolbar|complementary)(?=$|[\s_-])", re.I)
#: Dates and times as reader comments carry them, beside their author.
_MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
DATED = re.compile(rf"\b\d{{1,2}}:\d\d\b|\b\d{{4}}-\d\d-\d\d\b|\b\d{{1,2}}[./]\d{{1,2}}[./]\d{{2,4}}\b|\b(?:\d+|an?) (?:minute|hour|day|week|month|year)s? ago\b|\b\d{{1,2}}\.? (?:{_MONTHS})[a-z]*\b|\b(?:{_MONTHS})[a-z]* \d{{1,2}}\b", re.I)
AUTHOR = re.compile(r"[^\W\d_]{2,}")
#: Elements that a reader's comment stands in, blocks that one has at most, levels above a block that are looked at, characters
#: of a line with author or date at most, and comments that make a thread.
COMMENT, COMMENT_BLOCKS, LEVELS, BYLINE, THREAD = frozenset("div li section article dd blockquote".split()), 12, 8, 60, 2
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MARK = re.compile(r"[.,;:!?。、，！？]")
NAME = re.compile(r"[A-Za-z][^\s/>]*")
STOP = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"(?:^|[\s\"'])(class|id|role|hidden|aria-hidden)(?![\w-])(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
SPACES = re.compile(r"\s+")
#: Elements that parts of an article stand in.
CONTAINERS = frozenset("article main section div td body html".split())
#: A start tag that ends an open one of these, as HTML lets their end tags be missing.
ENDS = {"p": frozenset("p".split()), "li": frozenset("li".split()), "dt": frozenset("dt dd".split()), "dd": frozenset("dt dd".split()), "tr": frozenset("tr td th".split()), "td": frozenset("td th".split()), "th": frozenset("td th".split()), "option": frozenset("option".split())}
BLOCK_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split())
#: Neighbours to either side in the smoothing, the power of path likeness there, and the threshold as a part of the mean.
REACH, LIKENESS, THRESHOLD = 2, 4, 0.5
#: Factors of the page's own words, and the part of the selected text that the article's element holds.
INSIDE, AS_NAMED, MOST = 8.0, 1 / 8, 0.8


class Element(NamedTuple):
    tag: str
    parent: int
    path: int
    hidden: bool
    apart: bool
    named: bool
    inside: bool
    part: bool  # in a marked article, under a word that its own parts may carry


class Block(NamedTuple):
    element: int
    text: str
    linked: int  # characters in links


class Page:
    """Elements (parents first), tag paths as a tree of (parent path, tag), and text blocks of a page."""

    def __init__(self, page: str, hints: bool = True):
        self.elements = [Element("", -1, 0, False, False, False, False, False)]
        self.paths, self.depth = [-1], [0]
        self.blocks: list[Block] = []
        self._known: dict[tuple[int, str], int] = {}
        self.hints = hints
        self._read(page)

    def _read(self, page: str) -> None:
        stack: list[tuple[str, int]] = []  # tag and element; inline tags have the element around them
        open_at: dict[str, list[int]] = {}  # places in the stack by tag
        blocks_at: list[int] = []  # places in the stack of elements that aren't inline
        words: list[str] = []
        linked = 0
        quotes = True
        last = page.rfind(">")
        at, text_from = 0, 0

        def say(upto: int) -> None:
            nonlocal linked
            if upto > text_from and not self.elements[stack[-1][1] if stack else 0].hidden:
                text = page[text_from:upto]
                text = entities.unescape(text) if "&" in text else text
                words.append(text)
                if open_at.get("a"):
                    linked += len(text)

        def flush() -> None:
            nonlocal linked
            if words:
                text = SPACES.sub(" ", "".join(words)).strip()
                words.clear()
                if text:
                    self.blocks.append(Block(stack[-1][1] if stack else 0, text, min(linked, len(text))))
                linked = 0

        def close(upto: int) -> None:
            if blocks_at and blocks_at[-1] >= upto:
                flush()
                while blocks_at and blocks_at[-1] >= upto:
                    blocks_at.pop()
            for tag, _ in stack[upto:]:
                open_at[tag].pop()
            del stack[upto:]

        while True:
            at = page.find("<", at)
            if at < 0 or at > last:
                break
            if page.startswith("<!--", at):
                say(at)
                end = page.find("-->", at + 4)
                at = text_from = end + 3 if end >= 0 else len(page)
                continue
            if page.startswith("<![CDATA[", at):
                say(at)
                end = page.find("]]>", at)
                at = text_from = end + 3 if end >= 0 else len(page)
                continue
            if page[at + 1 : at + 2] in ("!", "?"):
                say(at)
                at = text_from = page.index(">", at) + 1
                continue
            ending = page[at + 1 : at + 2] == "/"
            name = NAME.match(page, at + 1 + ending)
            if not name:
                at += 1
                continue
            say(at)
            end = name.end()
            while quotes and (stop := STOP.search(page, end)) and stop[0] != ">":
                end = page.find(stop[0], stop.end()) + 1
                if not end:
                    stop = None
                    break
            if quotes and stop:
                end = stop.end()
            else:  # a quote stays open: from here on tags end at the first >
                quotes = False
                end = page.index(">", name.start()) + 1
            attributes, tag = page[name.end() : end - 1], name[0].lower().rstrip(">")
            at = text_from = end
            if ending:
                if places := open_at.get(tag):
                    if tag not in INLINE or not blocks_at or places[-1] > blocks_at[-1]:
                        close(places[-1])
            elif tag in VOID:
                if tag == "br":
                    words.append(" ")
                elif tag not in INLINE:
                    flush()
            else:
                k = len(stack)
                ends = ENDS.get(tag, ())
                for j in reversed(blocks_at[-3:]):  # a cell may stand in a row, and a paragraph in a cell
                    if stack[j][0] in ends or (stack[j][0] == "p" and tag in BLOCK_ENDS_P):
                        k = j
                    else:
                        break
                close(k)
                if tag in INLINE:
                    if not attributes.endswith("/"):
                        open_at.setdefault(tag, []).append(len(stack))
                        stack.append((tag, stack[-1][1] if stack else 0))
                    continue
                flush()
                if tag in RAW or tag in HIDDEN and attributes.endswith("/"):
                    if tag in RAW:
                        found = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                        at = text_from = found.end() if found else len(page)
                    continue
                if attributes.endswith("/"):
                    continue
                open_at.setdefault(tag, []).append(len(stack))
                blocks_at.append(len(stack))
                stack.append((tag, self._element(tag, stack[-1][1] if stack else 0, attributes)))
        say(len(page))
        flush()

    def _element(self, tag: str, parent: int, attributes: str) -> int:
        up = self.elements[parent]
        path = self._known.setdefault((up.path, tag), len(self.paths))
        if path == len(self.paths):
            self.paths.append(up.path)
            self.depth.append(self.depth[up.path] + 1)
        own = {a.lower(): v.strip("\"'") for a, v in ATTRIBUTE.findall(attributes)} if attributes else {}
        hidden = up.hidden or tag in HIDDEN or "hidden" in own or own.get("aria-hidden", "").lower() == "true"
        apart = named = inside = part = False
        if self.hints:
            main = tag in ("article", "main")
            said = [v for a in ("class", "id", "role") if (v := own.get(a))]
            apart = up.apart or tag in APART or (tag == "header" and not up.inside)
            names = [w[0].strip(" _-").lower() for v in said for w in NAMED.finditer(v)]
            head = not up.inside and any(NAMED_HEAD.search(v) for v in said)
            own_part = up.inside and bool(names) and all(NAMED_PART.search(w) for w in names)
            part = up.part or own_part
            named = not main and (up.named or (bool(names) and not own_part or head) and tag not in ("html", "body"))
            inside = up.inside or main and not apart
        self.elements.append(Element(tag, parent, path, hidden, apart, named, inside, part))
        return len(self.elements) - 1

    def threads(self) -> set[int]:
        """Elements that hold THREAD comments or more: like children that each have an author and a date in short lines, and text."""
        size = np.zeros(len(self.elements), np.int64)
        for b in self.blocks:
            size[b.element] += 1
        for i in range(len(self.elements) - 1, 0, -1):
            size[self.elements[i].parent] += size[i]
        seen: dict[int, list[Block]] = {}
        for b in self.blocks:
            i = b.element
            for _ in range(LEVELS):
                if not i or size[i] > COMMENT_BLOCKS:
                    break
                if self.elements[i].tag in COMMENT and size[i] > 1:
                    seen.setdefault(i, []).append(b)
                i = self.elements[i].parent
        like: dict[tuple[int, str], list[int]] = {}
        for i, own in seen.items():
            short = [b.text for b in own if len(b.text) <= BYLINE and not b.text.endswith((".", "!", "?"))]
            dated = [t for t in short if DATED.search(t)]
            named = any(AUTHOR.search(DATED.sub("", t)) for t in short)
            headed = any(self.elements[b.element].tag in HEADINGS for b in own)
            if dated and named and not headed and len(own) > len(dated) and len(own) == size[i]:
                like.setdefault((self.elements[i].parent, self.elements[i].tag), []).append(i)
        return {parent for (parent, _), items in like.items() if len(items) >= THREAD and 2 * size[items].sum() > size[parent]}

    def likeness(self, a: int, b: int) -> float:
        """1 less the steps between two paths of the tree as a part of both depths."""
        steps, both = 0, self.depth[a] + self.depth[b]
        while a != b:
            if self.depth[a] >= self.depth[b]:
                a = self.paths[a]
            else:
                b = self.paths[b]
            steps += 1
        return 1 - steps / both if both else 1.0


def path_scores(page: Page, own: list[Block]) -> dict[tuple[int, bool, bool], float]:
    """The smoothed and fused ratios of each path (path, named, in the article) of the blocks ``own``."""
    keys = [(page.elements[b.element].path, page.elements[b.element].named, page.elements[b.element].inside) for b in own]
    row = {k: i for i, k in enumerate(dict.fromkeys(keys))}
    at = np.array([row[k] for k in keys])
    size = np.array([len(b.text) - b.linked for b in own], float)
    mark = np.array([len(MARK.findall(b.text)) if b.linked < len(b.text) else 0 for b in own], float)
    count = np.bincount(at)
    ratios = np.stack([(np.bincount(at, size) + 1) / count, (np.bincount(at, mark) + 1) / count])[:, at]
    total, weight = ratios.copy(), np.ones(len(own))
    for step in range(1, min(REACH + 1, len(own))):
        like = np.array([page.likeness(keys[i][0], keys[i + step][0]) for i in range(len(own) - step)]) ** LIKENESS * np.exp(-step * step / 2)
        total[:, :-step] += like * ratios[:, step:]
        weight[:-step] += like
        total[:, step:] += like * ratios[:, :-step]
        weight[step:] += like
    fused = np.sqrt(np.prod(total / weight, axis=0))
    mean = np.bincount(at, fused) / count
    factor = {k: (AS_NAMED if k[1] else 1.0) * (INSIDE if k[2] else 1.0) for k in row}
    return {k: float(mean[i]) * factor[k] for k, i in row.items()}


def content(page: Page) -> tuple[list[Block], list[bool]]:
    """The candidate blocks, and which of them the article has."""
    own = [b for b in page.blocks if not page.elements[b.element].apart]
    if page.hints and (threads := page.threads()):
        inside = np.zeros(len(page.elements), bool)
        for i, e in enumerate(page.elements):
            inside[i] = i in threads or i > 0 and inside[e.parent]
        own = [b for b in own if not inside[b.element]] or own
    if not own:
        return [], []
    scores = path_scores(page, own)
    score = [scores[(e := page.elements[b.element]).path, e.named, e.inside] for b in own]
    least = THRESHOLD * np.average(score, weights=[len(b.text) for b in own])
    selected = [s >= least for s in score]
    held = np.zeros(len(page.elements))
    for b, s in zip(own, selected, strict=True):
        held[b.element] += len(b.text) * s
    for i in range(len(page.elements) - 1, 0, -1):
        held[page.elements[i].parent] += held[i]
    root = max((i for i in range(len(page.elements)) if held[i] >= MOST * held[0]), default=0)
    up = lambda i: page.elements[page.elements[i].parent]
    while root and (page.elements[root].tag not in CONTAINERS or up(root).inside):
        root = page.elements[root].parent
    if page.elements[root].tag in ("", "html", "body"):
        return own, selected
    within = np.zeros(len(page.elements), bool)
    for i, e in enumerate(page.elements):
        within[i] = i == root or i > 0 and within[e.parent]
    # links among the text of a marked article are its own, elsewhere they lead away
    marked = page.elements[root].inside
    also = [bool(within[b.element]) and (marked or 2 * b.linked <= len(b.text)) and page.elements[b.element].named <= page.elements[root].named and not page.elements[b.element].part for b in own]
    return own, [s or a for s, a in zip(selected, also, strict=True)]


def main_text(html: str, hints: bool = True) -> str:
    """The article's text: its blocks in page order, joined by one space. Without ``hints`` only the ratios decide."""
    return " ".join(b.text for b, keep in zip(*content(Page(html, hints)), strict=True) if keep)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h) if h else "" for h in batch.column("html").to_pylist()]
        yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of ``pages`` (page_id, url, html).

    Other columns are ignored. Null, empty and textless pages give an empty text. Repeated rows are read each by itself.
    An empty table gives no rows.
    """
    kinds = dict(pages.dtypes)
    return map_arrow(pages.select("page_id", "url", "html"), _extract, f"page_id {kinds['page_id']}, url string, text string, n_chars bigint")
