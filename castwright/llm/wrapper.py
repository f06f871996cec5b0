"""Main text of web pages by wrapper induction over the pages of a host.

1. Pages of a host are told apart by layout, the set of paths of their containers. A layout with at least `SURE` distinct
   pages is a cluster, the other pages of the host are one more. "Host" below means such a cluster, "page" a distinct
   content: copies count once. One page of each, by a hash of its id, is the reference. Every page's tree is aligned with the reference by simple
   tree matching: roots must agree in tag and in being furniture, children are aligned in order for the largest number of
   matched nodes of their whole subtrees (dynamic programming). A run of equal-tagged leaves is placed as one, with the
   matched nodes of all its members as weight.
2. Over all pages of the host, each reference node gets: pages matched, pages with the same text, characters. Nodes
   whose text never changes are template; those that vary are slots. Counts are summed per task first, so a host with
   a third of all pages is no hot group; the reference is the only page that meets others.
3. The content region is the deepest node that holds most of the varying text, outside navigation and other furniture
   known by tag, role or class name. A word of class, id or role, or a form, marks no furniture where the subtrees it
   marks hold most of the varying text (of an article or main element outside furniture, or else of the page). A page's content is its node aligned with the region; if there is none, or the host
   has one page, or all its pages are alike, the same rule is applied to the page's own text.
4. Inside the region furniture is left out, and constant nodes (same text on every one of at least `SURE` pages and of
   nine tenths of the region's pages, while the region itself varies). Everything else stays, whole.

Null pages are empty and have empty text; a null or odd url counts as a host of its own kind (the empty host); pages alike
come out alike; repeated rows stay rows. Broken markup (open tags, cut pages, stray ends) is read as browsers do in outline.
"""

from __future__ import annotations

import html as html_entities
import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castwright.llm.common import checked, land

SURE, MOST, DEEP = 5, 0.6, 6
PLAIN = -1  # stands for a whole page without its furniture, in place of a node
# A tag ends at the first `>` outside quotes. Where there is none up to the end of the page, quotes are broken: from there on they
# mean nothing, and a tag holds no `<`. So no text is scanned twice, however odd the page is.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*+>|<\?[^>]*+>|<(/?)([a-zA-Z][^\s/><]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?=[a-zA-Z/!])[^<]*+\Z|<(?P<broken>(?=/?[a-zA-Z]|[!?]))", re.S)
_BARE = re.compile(r"<!--.*?(?:-->|\Z)|<![^<>]*+>|<\?[^<>]*+>|<(/?)([a-zA-Z][^\s/><]*+)([^<>]*+)>|<(?=[a-zA-Z/!])[^<]*+\Z", re.S)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_PARTS = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math".split())
_ENDS = {name: re.compile(f"</{name}(?=[\\s/>])", re.I) for name in RAW}
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body"}
SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}}
SCOPE = frozenset("ul ol dl table select article section div body html".split())
# Containers whose paths tell a page's layout; lists, quotations and tables belong to the text.
FRAME = frozenset("html body div section article main center td".split())
# Furniture of a page: by tag, and, where they do not hold most of the text, by words of class, id and role, and forms.
TAGS = frozenset("head nav footer aside button select dialog menu script style noscript template iframe svg math textarea title object canvas audio video".split())
WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs footer contentinfo sidebar complementary aside ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices alert comment comments disqus reply replies share sharing social related recommended newsletter subscribe subscription signup login search popup modal overlay pagination pager skip masthead topbar toolbar widget".split()
)


def checksums(texts: list[str]) -> bytes:
    """Four bytes for each text."""
    return b"".join(zlib.crc32(t.encode("utf-8", "replace")).to_bytes(4, "big") for t in texts)


class Page:
    """A page's tree: per node tag, parent, children (texts and node numbers in order), furniture words, furniture or not."""

    __slots__ = ("tags", "parents", "kids", "hard", "words", "marked", "junk", "sizes")

    def __init__(self, source: str, frame_only: bool = False) -> None:
        """`frame_only`: furniture words are not read, for `layout` alone."""
        self.tags, self.parents, self.kids, self.hard, self.words = ["#"], [-1], [[]], [False], [frozenset()]
        self.read(source, not frame_only)
        self.sizes = None
        if frame_only:
            return
        self.junk = self.hard
        self.judge(frozenset())
        self.marked = self.junk  # as matching sees it, whatever is judged later

    def judge(self, free: frozenset[str]) -> None:
        """Settle what is furniture: by tag, or by a word that is not among `free`; all below it too."""
        junk = self.hard.copy()
        for i in range(1, len(junk)):
            junk[i] = junk[i] or junk[self.parents[i]] or not self.words[i] <= free
        self.junk = junk

    def digests(self, runs: list[list[int]]) -> list[int]:
        """A checksum of the text of each run of nodes, without furniture by tag; the first without any furniture."""
        self.junk = self.marked
        out = [zlib.crc32(checksums(self.blocks(runs[0][0])))]
        self.junk = self.hard
        spans: dict[int, tuple[int, int]] = {}
        page = checksums(self.blocks(0, spans=spans))
        spans[0] = (0, len(page) // 4)
        for nodes in runs[1:]:
            parts = [page[4 * spans[n][0] : 4 * spans[n][1]] if n in spans else checksums(self.blocks(n)) for n in nodes]
            out.append(zlib.crc32(b"".join(parts)))
        return out

    def read(self, source: str, with_words: bool) -> None:
        tags, parents, kids, at, end = self.tags, self.parents, self.kids, 0, 0
        search = _TOKEN.search
        while m := search(source, end):
            if m.lastgroup:  # broken
                search = _BARE.search
                continue
            if m.start() > end:
                kids[at].append(source[end : m.start()])
            name = m.group(2)
            end = m.end()
            if not name:
                continue
            name = name.lower()
            if m.group(1):
                node = at
                while node > 0 and tags[node] != name:
                    if tags[node] in ("td", "th", "table") and name not in BLOCK:
                        node = 0
                        break
                    node = parents[node]
                if node > 0:
                    at = parents[node]
                elif name in ("br", "p"):
                    kids[at].append(" ")
                continue
            node = at
            if name in CLOSES_P:
                while node > 0 and tags[node] != "p" and tags[node] not in BLOCK:
                    node = parents[node]
                if node > 0 and tags[node] == "p":
                    at = parents[node]
            if name in SIBLING:
                node = at
                while node > 0 and tags[node] not in SCOPE:
                    if tags[node] in SIBLING[name]:
                        at = parents[node]
                    node = parents[node]
            attributes = m.group(3)
            if name in VOID:
                kids[at].append(" ")  # a line break or picture parts words
                continue
            tags.append(name)
            parents.append(at)
            kids.append([])
            self.hard.append(self.hard[at] or self.furniture(name, at))
            if with_words:
                self.words.append(self.furniture_words(name, attributes))
            kids[at].append(len(tags) - 1)
            if attributes.endswith("/") and name not in BLOCK:
                continue
            at = len(tags) - 1
            if name in RAW:  # its text ends at its own end tag only
                close = _ENDS[name].search(source, end)
                end = close.start() if close else len(source)
        if end < len(source):
            kids[at].append(source[end:])

    def furniture(self, name: str, parent: int) -> bool:
        if name in TAGS:
            return True
        if name == "header":  # a page's header; an article's own holds its title
            while parent > 0 and self.tags[parent] not in ("article", "main"):
                parent = self.parents[parent]
            return parent <= 0
        return False

    @staticmethod
    @lru_cache(maxsize=4096)  # the pages of a host repeat their attributes
    def furniture_words(name: str, attributes: str) -> frozenset[str]:
        if name == "form":
            return frozenset(["<form>"])
        if not attributes or name in ("html", "body", "article", "main"):
            return frozenset()
        found: set[str] = set()
        for value in _NAMES.findall(attributes):
            for name in value.strip("\"'").split():
                bare = name.lower()
                # A name that is the word itself is told from one that holds it, as `sidebar` from `has-sidebar`.
                found.update(["=" + bare] if bare in WORDS else WORDS.intersection(_PARTS.split(name) + _PARTS.split(bare)))
        return frozenset(found)

    def free_words(self, text: list[int], base: int = 0) -> frozenset[str]:
        """Words that are no furniture here: the subtrees they mark hold together most of the text below `base`.

        `text`: characters of text below each node, without furniture by tag.
        """
        held: dict[str, int] = {}
        above: dict[int, frozenset[str]] = {base: frozenset()}
        for i in range(base + 1, len(self.tags)):
            if self.parents[i] in above:
                seen = above[self.parents[i]]
                above[i] = seen | self.words[i]
                for word in self.words[i] - seen:
                    held[word] = held.get(word, 0) + text[i]
        return frozenset(w for w, n in held.items() if 2 * n > text[base])

    def layout(self) -> int:
        """A number for the set of paths of the page's containers outside furniture; -1 for a page without any."""
        paths = [""]
        for i in range(1, len(self.tags)):
            up = paths[self.parents[i]]
            depth = up.count("/")
            paths.append(f"{up}/{self.tags[i]}" if self.tags[i] in FRAME and not self.hard[i] and depth < DEEP else up)
        found = {*paths} - {""}
        return zlib.crc32(" ".join(sorted(found)).encode()) if found else -1

    def blocks(self, root: int, without: frozenset[int] = frozenset(), spans: dict[int, tuple[int, int]] | None = None) -> list[str]:
        """Texts of the blocks below a node, in order, white space folded. `spans` gets the place of each block element's own."""
        out, parts, tags, kids, junk = [], [], self.tags, self.kids, self.junk

        def close() -> None:
            text = "".join(parts)
            text = " ".join((html_entities.unescape(text) if "&" in text else text).split())
            parts.clear()
            if text:
                out.append(text)

        stack = [iter((root,))]
        names = [False]
        opened: list[tuple[int, int]] = []
        while stack:
            child = next(stack[-1], None)
            if child is None:
                stack.pop()
                if names.pop():
                    close()
                    node, start = opened.pop()
                    if spans is not None:
                        spans[node] = (start, len(out))
            elif isinstance(child, str):
                parts.append(child)
            elif not (junk[child] and child != root) and child not in without:
                block = tags[child] in BLOCK
                if block:
                    close()
                    opened.append((child, len(out)))
                stack.append(iter(kids[child]))
                names.append(block)
        close()
        return out

    def weights(self) -> list[int]:
        """Characters of text below each node, without furniture by tag."""
        if self.sizes is None:
            sizes = [0 if self.hard[i] else sum(len(k.strip()) for k in kids if isinstance(k, str)) for i, kids in enumerate(self.kids)]
            for i in range(len(sizes) - 1, 0, -1):
                sizes[self.parents[i]] += sizes[i]
            self.sizes = sizes
        return self.sizes

    def plain_size(self) -> int:
        """Characters outside all furniture, words and forms included."""
        self.junk = self.marked
        return self.net(self.weights())[0]

    def settle(self, text: list[int]) -> frozenset[str]:
        """Judge furniture by where the text stands: in an article or main element outside furniture, or else in the page."""
        self.judge(frozenset())
        named = [i for i, t in enumerate(self.tags) if t in ("article", "main") and not self.junk[i] and text[i]]
        free = self.free_words(text, max(named, key=lambda i: (text[i], -i)) if named else 0)
        self.judge(free)
        return free

    def shape(self, node: int) -> list[list[int]]:
        """Children of a node for matching: runs of leaves with one tag are one group."""
        groups: list[list[int]] = []
        for k in self.kids[node]:
            if isinstance(k, int):
                leaf = all(isinstance(x, str) or self.tags[x] not in BLOCK for x in self.kids[k])
                if groups and leaf and self.tags[groups[-1][0]] == self.tags[k] and self.marked[groups[-1][0]] == self.marked[k] and groups[-1][-1] >= 0 and all(isinstance(x, str) or self.tags[x] not in BLOCK for x in self.kids[groups[-1][-1]]):
                    groups[-1].append(k)
                else:
                    groups.append([k])
        return groups

    def net(self, text: list[int]) -> list[int]:
        """`text` (characters below each node, without furniture by tag) without any furniture."""
        own = text.copy()
        for i in range(1, len(own)):
            own[self.parents[i]] -= text[i]
        out = [0 if junk else n for n, junk in zip(own, self.junk, strict=True)]
        for i in range(len(out) - 1, 0, -1):
            out[self.parents[i]] += out[i]
        return out

    def own_region(self) -> int:
        """The deepest node with most of the page's text; an article or main element that holds it, if there is one."""
        self.settle(self.weights())
        sizes, node = self.net(self.weights()), 0
        named = [i for i, t in enumerate(self.tags) if t in ("article", "main") and not self.junk[i] and sizes[i]]
        if named:
            return max(named, key=lambda i: (sizes[i], -i))
        while True:
            inner = [k for k in self.kids[node] if isinstance(k, int) and self.tags[k] in BLOCK]
            best = max(inner, key=lambda k: sizes[k], default=None)
            if best is None or sizes[best] < MOST * sizes[node] or not sizes[best] or not any(isinstance(k, int) and self.tags[k] in BLOCK for k in self.kids[best]):
                return node
            node = best


class Matching:
    """Simple tree matching of two pages: the largest number of node pairs that agree in key, parents paired, in order.

    Nodes with equal subtrees share a class, and a score is kept per pair of classes, so that long runs of equal
    children cost one score. Scores are found from low subtrees up, without recursion, as broken pages nest deeply.
    """

    def __init__(self, a: Page, b: Page) -> None:
        names: dict[tuple, int] = {}
        self.kids: list[list[int]] = []  # of a class: its children's classes
        self.keys: list[tuple[str, bool]] = []
        self.sizes: list[int] = []
        self.heights: list[int] = []
        self.classes = tuple(self._classes(p, names) for p in (a, b))
        self.known: dict[tuple[int, int], int] = {}
        top = (self.classes[0][0], self.classes[1][0])
        needed, stack = {top}, [top]
        while stack:
            x, y = stack.pop()
            for c in {*self.kids[x]}:
                for d in {*self.kids[y]}:
                    if c != d and self.keys[c] == self.keys[d] and self.kids[c] and self.kids[d] and (c, d) not in needed:
                        needed.add((c, d))
                        stack.append((c, d))
        for x, y in sorted(needed, key=lambda pair: self.heights[pair[0]]):
            self.known[x, y] = 1 + self.run(self.kids[x], self.kids[y])

    def _classes(self, page: Page, names: dict[tuple, int]) -> list[int]:
        out = [0] * len(page.tags)
        for i in range(len(out) - 1, -1, -1):  # children have higher numbers
            kids = [out[k] for k in page.kids[i] if isinstance(k, int)]
            name = (page.tags[i], page.marked[i], *kids)
            if name not in names:
                names[name] = len(names)
                self.kids.append(kids)
                self.keys.append(_key(page, i))
                self.sizes.append(1 + sum(self.sizes[k] for k in kids))
                self.heights.append(1 + max((self.heights[k] for k in kids), default=0))
            out[i] = names[name]
        return out

    def score(self, x: int, y: int) -> int:
        """Matched nodes of two subtrees, given by class; 0 if their roots do not agree."""
        if x == y:
            return self.sizes[x]
        if self.keys[x] != self.keys[y]:
            return 0
        return self.known[x, y] if self.kids[x] and self.kids[y] else 1

    def run(self, a: list[int], b: list[int]) -> int:
        """Matched nodes of two runs of siblings, paired in order."""
        start, end = 0, 0
        least = min(len(a), len(b))
        while start < least and a[start] == b[start]:  # pairing equal subtrees at an end is never worse
            start += 1
        while end < least - start and a[-1 - end] == b[-1 - end]:
            end += 1
        equal = sum(self.sizes[c] for c in a[:start]) + sum(self.sizes[c] for c in a[len(a) - end :])
        a, b = a[start : len(a) - end], b[start : len(b) - end]
        if not a or not b:
            return equal
        one, two = [*{*a}], [*{*b}]
        table = np.array([[self.score(c, d) for d in two] for c in one], np.int64)
        places = np.array([*map({d: j for j, d in enumerate(two)}.__getitem__, b)])
        rows = {c: table[i, places] for i, c in enumerate(one)}
        best = np.zeros(len(b) + 1, np.int64)
        for c in a:
            best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + rows[c]))
        return equal + int(best[-1])


def match(a: Page, b: Page) -> dict[int, list[int]]:
    """For each node of `a` that is matched, its nodes in `b` (several for a run of leaves, which is placed as one)."""
    matching = Matching(a, b)
    ours, theirs = matching.classes
    found: dict[int, list[int]] = {0: [0]}
    queue = deque([(0, 0)])
    while queue:
        x, y = queue.popleft()
        left, right = a.shape(x), b.shape(y)
        one, two = [[ours[n] for n in g] for g in left], [[theirs[n] for n in g] for g in right]
        for i, j in align(one, two, matching):
            found[left[i][0]] = right[j]
            if len(left[i]) == 1 and len(right[j]) == 1:
                queue.append((left[i][0], right[j][0]))
    return found


def _key(page: Page, node: int) -> tuple[str, bool]:
    return page.tags[node], page.marked[node]


def align(a: list[list[int]], b: list[list[int]], matching: Matching) -> list[tuple[int, int]]:
    """Pairs of groups (lists of classes of siblings) with equal keys, in order, with the largest total of matched nodes."""
    if a == b:
        return [(i, i) for i in range(len(a))]
    pairs: dict[tuple[tuple[int, ...], tuple[int, ...]], int] = {}
    both = [[0] * len(b) for _ in a]
    for i, g in enumerate(a):
        for j, h in enumerate(b):
            if matching.keys[g[0]] == matching.keys[h[0]]:
                name = (tuple(g), tuple(h))
                if name not in pairs:
                    pairs[name] = matching.score(g[0], h[0]) if len(g) == len(h) == 1 else matching.run(g, h)
                both[i][j] = pairs[name]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + both[i][j])
    i = j = 0
    out = []
    while i < len(a) and j < len(b):
        if both[i][j] and best[i][j] == best[i + 1][j + 1] + both[i][j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return out


class References:
    """Parsed reference pages of a task, the last few hosts."""

    def __init__(self) -> None:
        self.kept: dict[str, Page] = {}
        self.texts: dict[str, dict[int, int]] = {}
        self.found: dict[str, dict[tuple, dict[int, list[int]]]] = {}
        self.regions: dict[str, tuple[int, set[int], frozenset[str]]] = {}

    def of(self, host: str, source: str) -> Page:
        if host not in self.kept:
            if len(self.kept) > 64:
                self.kept.clear()
                self.texts.clear()
                self.found.clear()
                self.regions.clear()
            self.kept[host] = Page(source)
        return self.kept[host]

    def match(self, host: str, page: Page) -> dict[int, list[int]]:
        """The page matched with a kept reference; pages with equal trees match alike."""
        known = self.found.setdefault(host, {})
        tree = (tuple(page.tags), tuple(page.parents), tuple(page.marked))
        if tree not in known:
            if len(known) >= 64:
                known.clear()
            known[tree] = match(self.kept[host], page)
        return known[tree]

    def digest(self, host: str, node: int) -> int:
        """The checksum of a kept reference's node."""
        if host not in self.texts:
            page = self.kept[host]
            runs = {PLAIN: [0], 0: [0]} | {g[0]: g for n in range(len(page.tags)) for g in page.shape(n)}
            self.texts[host] = dict(zip(runs, page.digests([*runs.values()]), strict=True))
        return self.texts[host][node]


def region_of(reference: Page, stats: list[tuple[int, int, int, int]]) -> tuple[int, set[int], frozenset[str]]:
    """The reference's region node (-1: no evidence), its constant nodes and the words that are no furniture, from (node, pages, same, chars)."""
    table = {node: (pages, same, chars) for node, pages, same, chars in stats}
    seen, fixed, outside = table.pop(PLAIN, (0, 0, 0))
    if fixed == seen and 0 in table and 2 * outside > table[0][2]:  # copies, but for furniture
        return -1, set(), frozenset()
    varies = {n for n, (pages, same, _) in table.items() if pages > 1 and same < pages}
    if 0 not in varies:
        return -1, set(), frozenset()
    # Varying characters: of a node that varies, what its children do not hold, and theirs.
    text = [0] * len(reference.tags)
    for n in varies:
        text[n] += table[n][2]
        if n and reference.parents[n] in varies:
            text[reference.parents[n]] -= table[n][2]
    for n in table.keys() - varies:
        if reference.parents[n] in varies:
            text[reference.parents[n]] -= table[n][2]
    for i in range(len(text) - 1, 0, -1):
        text[reference.parents[i]] += text[i]
    free = reference.settle(text)
    net = reference.net(text)
    named = [n for n in varies if reference.tags[n] in ("article", "main") and not reference.junk[n] and net[n] > 0]
    region = max(named, key=lambda n: (net[n], -n)) if named else 0
    while not named:
        inner = [k for k in reference.kids[region] if isinstance(k, int) and k in varies and not reference.junk[k]]
        best = max(inner, key=net.__getitem__, default=None)
        if best is None or net[best] < MOST * net[region] or not any(isinstance(k, int) and reference.tags[k] in BLOCK for k in reference.kids[best]):
            break
        region = best
    pages, same, _ = table[region]
    sure = pages >= SURE and same * 2 < pages
    return region, {n for n, (p, s, _) in table.items() if sure and s == p >= SURE and 10 * p >= 9 * pages and n != region}, free


def extract(page: Page, found: dict[int, list[int]], region: int, constant: set[int], free: frozenset[str]) -> str:
    """The main text of one page; `found`: its nodes by those of the reference (none without a reference)."""
    page.judge(free)
    if nodes := found.get(region, []):
        without = frozenset(n for c in constant for n in found.get(c, []))
        text = "\n\n".join(t for n in nodes for t in page.blocks(n, without))
        if text:
            return text
    region = page.own_region()
    return "\n\n".join(page.blocks(region)) if not page.junk[region] else ""


def layouts(html: pd.Series) -> pd.Series:
    return html.map(lambda source: Page(source, frame_only=True).layout() if isinstance(source, str) else -1).astype("int64")


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row: key, url, text, n_chars (code points)."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = checked(pages, key, url, html).withColumns({"host": host, "layout": F.pandas_udf(layouts, "long")(F.col(html))})
    # Layouts of a host with enough distinct pages have a wrapper of their own; its other pages share one.
    alike = rows.where(F.col(html).isNotNull()).groupBy("host", "layout").agg(F.countDistinct(F.xxhash64(html)).alias("n"))
    own = land(alike.where(F.col("n") >= SURE).select("host", "layout", F.lit(True).alias("own")))
    named = F.concat_ws("\n", "host", F.when(F.col("own"), F.col("layout").cast("string")))
    rows = rows.join(own, ["host", "layout"], "left").select(key, url, html, named.alias("host"))
    present = rows.where(F.col(html).isNotNull())
    chosen = present.groupBy("host").agg(F.min_by(html, F.struct(F.xxhash64(key, url), key, url, html)).alias("reference"))
    chosen = land(chosen)
    paired = present.select("host", html).distinct().join(chosen, "host")  # copies are no evidence

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        references = References()
        for batch in batches:
            sums: dict[tuple[str, int], list[int]] = {}
            for i, (at, own) in enumerate(zip(batch["host"].to_pylist(), batch[html].to_pylist(), strict=True)):
                if at not in references.kept:
                    references.of(at, batch["reference"][i].as_py())
                page = Page(own)
                weights = page.weights()
                found = {PLAIN: [0], **references.match(at, page)}
                for node, nodes, text in zip(found, found.values(), page.digests([*found.values()]), strict=True):
                    total = sums.setdefault((at, node), [0, 0, 0])
                    total[0] += 1
                    total[1] += references.digest(at, node) == text
                    total[2] += sum(weights[n] for n in nodes) if node != PLAIN else page.plain_size()
            yield pa.RecordBatch.from_pydict({
                "host": pa.array([h for h, _ in sums], pa.string()), "node": pa.array([n for _, n in sums], pa.int32()),
                **{c: pa.array([v[i] for v in sums.values()], pa.int64()) for i, c in enumerate(("pages", "same", "chars"))},
            })

    counted = paired.select("host", html, "reference").mapInArrow(compare, "host string, node int, pages long, same long, chars long")
    nodes = counted.groupBy("host", "node").agg(F.sum("pages").alias("pages"), F.sum("same").alias("same"), F.sum("chars").alias("chars"))
    # A host's nodes are those of its one reference page.
    stats = land(nodes.groupBy("host").agg(F.collect_list(F.struct("node", "pages", "same", "chars")).alias("stats")))
    wrappers = land(chosen.join(stats, "host"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        references = References()
        for batch in batches:
            texts = []
            for i, (at, own) in enumerate(zip(batch["host"].to_pylist(), batch[html].to_pylist(), strict=True)):
                page = Page(own or "")
                if at not in references.kept and batch["reference"][i].is_valid:
                    kept = references.of(at, batch["reference"][i].as_py())
                    references.regions[at] = region_of(kept, [(s["node"], s["pages"], s["same"], s["chars"]) for s in batch["stats"][i].as_py() or []])
                region = references.regions.get(at, (-1, set(), frozenset()))
                texts.append(extract(page, references.match(at, page) if region[0] >= 0 else {}, *region))
            yield pa.RecordBatch.from_arrays([batch[key], batch[url], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[key, url, "text", "n_chars"])

    shape = f"`{key}` {rows.schema[key].dataType.simpleString()}, `{url}` string, text string, n_chars long"
    return rows.join(wrappers, "host", "left").mapInArrow(cut, shape)
