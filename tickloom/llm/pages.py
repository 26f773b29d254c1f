"""Main text of web pages by wrapper induction over pages of one host.

The trees of same-host pages are aligned by simple tree matching. What stays the same on the aligned pages is the host's template; slots
that vary hold content. Inside a page, marked page furniture (menus, headers, footers, sidebars, notices, adverts, forms,
reader comments) is left out, and the article is what varies in the marked article elements, or else in the page.

Pages are dealt by (host, part): a host of more than ``GROUP`` pages is cut by hash into parts of about that many, so it spreads over
many tasks. Each part is read as a whole with a wrapper of its own, however the parts fall to tasks.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.sizing import small_side
from .common import small_batches
from .urls import host_of

#: Pages aligned together (expected number), and distinct pages a template needs.
GROUP, LEAST = 64, 3
#: A text is template when this share of the aligned pages has it.
CONSTANT = 0.6
#: The bulk of a page's text. Template blocks that make up more of a marked article stay: its pages are copies of one story.
BULK = 0.8
#: A more exact mark of the article counts from this share of the text under the less exact ones on.
SHARE = 0.5
#: Differing middles of two lists of children whose product is larger are aligned half by half.
CELLS = 4000

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)
    |<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
    |<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)
    |(?P<text>[^<]+|<)""", re.S | re.X)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: Element names by role, as HTML defines them.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript template iframe xmp noframes noembed".split())
BLOCK = set("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr
    ul""".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
DROPPED = set("""head nav footer aside form button select option input label dialog menu svg canvas object applet audio video
    datalist map frameset""".split()) | RAW
#: Words of class, id and role that mark page furniture.
FURNITURE = set("""ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promotions
    nav navbar navigation menu breadcrumb breadcrumbs footer masthead topbar toolbar sidebar aside widget widgets cookie cookies consent gdpr
    notice notices notification notifications alert popup modal overlay newsletter subscribe subscription share sharing social related recommended
    recommendations comment comments disqus respond reply replies login signin signup register search pagination pager copyright
    complementary contentinfo skip hidden""".split())
#: Words of place, form and count, which say nothing of what an element holds: a name made of them and furniture words is furniture's.
ARRANGEMENT = set("""area article articles bar block bottom box button buttons container content count desktop div entry fixed form global group icon
    icons inline inner item items js left link links list main mobile outer page panel post posts primary reader right secondary section site slot
    sticky stories story title top unit user wrap wrapper""".split())
ARTICLE_WORDS = set("article articlebody post entry story content maincontent main".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}}
#: Inside a marked article these stay or go as a whole.
WHOLE = set("ul ol dl menu table".split())
SCOPE = set("ul ol table article section div body html main td th dl blockquote aside nav header footer form".split())


class Node:
    __slots__ = ("tag", "words", "hidden", "parts", "children", "own", "constant", "wraps", "shape", "named", "doubtful")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.words, self.hidden = tag, frozenset(), False
        self.parts: list = []          # texts and child nodes in order
        self.children: list[Node] = []
        self.own = self.constant = None
        self.named = self.doubtful = False  # a whole name says furniture; only a part of one does
        self.wraps = False             # holds the bulk of the page's content, whatever its class says
        if attrs.strip(" /"):
            marks = []
            for name, value in _ATTRIBUTE.findall(attrs):
                name, value = name.lower(), value.strip("\"'").lower()
                if name in ("class", "id", "role", "itemprop"):
                    for whole in value.split():
                        parts = [m for m in re.split(r"[^a-z0-9]+", whole) if m]
                        marks += parts
                        if not FURNITURE.isdisjoint(parts):
                            self.doubtful = True
                            self.named |= all(m in FURNITURE or m in ARRANGEMENT or m.isdigit() for m in parts)
                elif name == "hidden" or name == "aria-hidden" and value == "true" \
                        or name == "style" and re.search(r"display\s*:\s*none", value):
                    self.hidden = True
            self.words = frozenset(m for m in marks if m)

    def add(self, child: Node) -> Node:
        self.parts.append(child)
        self.children.append(child)
        return child


def parse(page: str) -> Node:
    """The element tree of a page; broken and unclosed markup is taken as browsers do, roughly."""
    root = Node("html")
    stack, at = [root], 0
    end = len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        if m["text"] is not None:
            stack[-1].parts.append(m["text"])
            continue
        name = m["tag"] or m["tag2"]
        if not name:
            if page.startswith("<![CDATA[", m.start()):
                stack[-1].parts.append(entities.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        tag, closing, attrs = name.lower(), bool(m["end"] or m["end2"]), m["attrs"] or m["attrs2"] or ""
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag not in BLOCK and stack[k].tag in BLOCK:
                    break
            continue
        if tag == "html":
            continue
        if tag in BLOCK:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in BLOCK:
                    break
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in CLOSES.get(tag, ()):
                del stack[k:]
                break
            if stack[k].tag in SCOPE and not (tag == "tr" and stack[k].tag in ("td", "th")):
                break
        if tag == "body" and any(n.tag == "head" for n in stack):
            del stack[1:]
        node = stack[-1].add(Node(tag, attrs))
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
        elif tag not in VOID and not attrs.rstrip().endswith("/") or tag in BLOCK:
            if len(stack) < 200:
                stack.append(node)
    return root


def _own_text(node: Node) -> str:
    if node.own is None:
        node.own = " ".join("".join(p if isinstance(p, str) else " " for p in node.parts).split())
    return node.own


def _kind(node: Node) -> tuple:
    return node.tag, node.words


class Matcher:
    """Simple tree matching: the largest order-preserving top-down match of two trees.

    The size of a match rests on tags and classes alone, so sizes are kept by the shapes of the subtrees, ``KEPT`` at most.
    """

    KEPT = 1_000_000

    def __init__(self):
        self.shapes: dict[tuple, int] = {}
        self.sizes: dict[tuple[int, int], int] = {}

    def shape(self, tree: Node) -> None:
        """Number the subtrees of a tree, equal ones alike."""
        for n in reversed(list(_walk(tree))):
            key = (*_kind(n), tuple(c.shape for c in n.children))
            n.shape = self.shapes.setdefault(key, len(self.shapes))

    @staticmethod
    def _ends(x: list[Node], y: list[Node]) -> tuple[int, int]:
        """Children of equal kind at the head and at the tail: they are aligned as they are."""
        head = tail = 0
        while head < min(len(x), len(y)) and _kind(x[head]) == _kind(y[head]):
            head += 1
        while tail < min(len(x), len(y)) - head and _kind(x[-1 - tail]) == _kind(y[-1 - tail]):
            tail += 1
        return head, tail

    def size(self, a: Node, b: Node) -> int:
        if a.tag != b.tag:
            return 0
        x, y = a.children, b.children
        if not x or not y:
            return 1
        key = a.shape, b.shape
        found = self.sizes.get(key)
        if found is None:
            head, tail = self._ends(x, y)
            found = 1
            for k in (*range(head), *range(-tail, 0)):
                found += self.size(x[k], y[k])
            x, y = x[head:len(x) - tail], y[head:len(y) - tail]
            if x and y:
                found += int(self._row(x, y)[-1])
            if len(self.sizes) >= self.KEPT:
                self.sizes.clear()
            self.sizes[key] = found
        return found

    def _row(self, x: list[Node], y: list[Node]) -> np.ndarray:
        """Sizes of the largest matches of all of ``x`` with the first 0, 1, ... of ``y``."""
        kinds = {v.shape: v for v in y}
        place = {k: n for n, k in enumerate(kinds)}
        at = np.array([place[v.shape] for v in y])
        best, last, w = np.zeros(len(y) + 1, np.int64), None, None
        for u in x:
            if u.shape != last:
                last, w = u.shape, np.array([self.size(u, v) for v in kinds.values()], np.int64)[at]
            here = np.where(w > 0, best[:-1] + w, 0)
            best[1:] = np.maximum.accumulate(np.maximum(best[1:], here))
        return best

    def _middle(self, x: list[Node], y: list[Node]) -> list[tuple[Node, Node]]:
        """The pairs of the largest match of two lists; long lists are halved where their halves match best."""
        if not x or not y:
            return []
        if len(x) > 1 and len(x) * len(y) > CELLS:
            half = len(x) // 2
            both = self._row(x[:half], y) + self._row(x[half:][::-1], y[::-1])[::-1]
            cut = int(both.argmax())
            return self._middle(x[:half], y[:cut]) + self._middle(x[half:], y[cut:])
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, u in enumerate(x, 1):
            for j, v in enumerate(y, 1):
                w = self.size(u, v)
                best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + w if w else 0)
        pairs, i, j = [], len(x), len(y)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((x[i], y[j]))
        return pairs

    def pairs(self, a: Node, b: Node) -> list[tuple[Node, Node]]:
        """The children that the largest match of two nodes of one tag aligns."""
        x, y = a.children, b.children
        head, tail = self._ends(x, y)
        ends = [*zip(x[:head], y[:head]), *zip(x[len(x) - tail:], y[len(y) - tail:])]
        return ends + self._middle(x[head:len(x) - tail], y[head:len(y) - tail])

    def aligned(self, template: Node, page: Node) -> Iterator[tuple[Node, Node]]:
        stack = [(template, page)]
        while stack:
            a, b = stack.pop()
            yield a, b
            stack += self.pairs(a, b)


class Wrapper:
    """A host's template: the tree of its richest page, with the texts that the aligned pages have at each node and below it.

    Blocks move up and down with the number of their siblings, so a text also counts by kind under the aligned parent.
    """

    def __init__(self, trees: list[Node]):
        self.template = max(trees, key=lambda t: sum(1 for _ in _walk(t)))
        self.matcher = Matcher()
        self.pages = len(trees)
        self.texts: dict[int, dict[str, int]] = {}
        self.below: dict[int, dict[tuple, int]] = {}
        self.pairs: dict[int, list[tuple[Node, Node]]] = {}
        for tree in trees:
            self.matcher.shape(tree)
        for tree in trees:
            self.pairs[id(tree)] = list(self.matcher.aligned(self.template, tree))
            for a, b in self.pairs[id(tree)]:
                counts = self.texts.setdefault(id(a), {})
                counts[_own_text(b)] = counts.get(_own_text(b), 0) + 1
                below = self.below.setdefault(id(a), {})
                for key in {(*_kind(c), _own_text(c)) for c in b.children if _own_text(c)}:
                    below[key] = below.get(key, 0) + 1

    def _template(self, same: int) -> bool:
        return same >= LEAST and same >= CONSTANT * self.pages

    def mark(self, tree: Node) -> None:
        """Mark the nodes of a page whose text is template."""
        pairs = self.pairs.pop(id(tree), None)
        if pairs is None:
            self.matcher.shape(tree)
            pairs = self.matcher.aligned(self.template, tree)
        for a, b in pairs:
            counts, below = self.texts.get(id(a), {}), self.below.get(id(a), {})
            b.constant = b.constant or bool(_own_text(b)) and self._template(counts.get(_own_text(b), 0))
            for c in b.children:
                c.constant = c.constant or bool(_own_text(c)) and self._template(below.get((*_kind(c), _own_text(c)), 0))


def _walk(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        n = stack.pop()
        yield n
        stack += n.children


def _furniture(node: Node) -> bool:
    if node.tag in ("html", "body", "article", "main") or node.wraps:
        return False
    if node.tag in DROPPED or node.hidden or node.named:
        return True
    if node.doubtful:
        node.doubtful, node.named = False, _mostly_links(node)
    return node.named


def _mostly_links(node: Node) -> bool:
    """Is more than half of the element's text in links, as in lists of other pages?"""
    total = linked = 0
    stack = [(node, False)]
    while stack:
        n, inside = stack.pop()
        inside |= n.tag == "a"
        size = sum(len(" ".join(x.split())) for x in n.parts if isinstance(x, str))
        total, linked = total + size, linked + size * inside
        stack += [(c, inside) for c in n.children if c.tag not in RAW]
    return 2 * linked > total


def _level(node: Node) -> int | None:
    """How a page marks its article: 0 by an article element, 1 as main, 2 by class, id or role."""
    if node.tag == "article":
        return 0
    if node.tag == "main" or "main" in node.words and node.tag != "body":
        return 1
    return 2 if node.words & ARTICLE_WORDS and node.tag in BLOCK and node.tag not in ("html", "body") else None


def _spare_wrappers(root: Node) -> None:
    """Mark the elements that are furniture by their class or as a form, yet hold the page's content.

    Content is the varying text in article and main elements, without furniture that holds no such element, or all varying text where they have none. An element that
    is itself marked as an article by class then holds it with more than half, any other with more than ``BULK``.
    """
    nodes = list(_walk(root))
    suspects = [n for n in nodes if n.children and not n.hidden and (n.tag == "form" or n.tag not in DROPPED) and _furniture(n)]
    if not suspects:
        return
    for varying in (True, False):
        every: dict[int, int] = {}
        inside: dict[int, int] = {}
        strong: dict[int, int] = {}
        marks: set[int] = set()
        for n in reversed(nodes):
            if n.hidden or n.tag in DROPPED and n.tag != "form":
                every[id(n)] = inside[id(n)] = strong[id(n)] = 0
                continue
            own, mark = 0 if varying and n.constant else len(_own_text(n)), n.tag in ("article", "main")
            if mark or any(id(c) in marks for c in n.children):
                marks.add(id(n))
            every[id(n)] = own + sum(every[id(c)] for c in n.children)
            inside[id(n)] = 0 if id(n) not in marks and _furniture(n) else own + sum(inside[id(c)] for c in n.children)
            strong[id(n)] = inside[id(n)] if mark else sum(strong[id(c)] for c in n.children)
        if every[id(root)]:
            break
    held = strong if strong[id(root)] else every
    for n in suspects:
        least = 0.5 if held is every and _level(n) is not None else BULK
        n.wraps = held[id(n)] > least * held[id(root)]


def _length(node: Node) -> int:
    """Characters of text outside furniture and template."""
    total, stack = 0, [node]
    while stack:
        n = stack.pop()
        if not _furniture(n) or n is node:
            total += 0 if n.constant else len(_own_text(n))
            stack += n.children
    return total


def _article(root: Node) -> tuple[list[Node], bool]:
    """The content elements in page order, and whether the page marks them as such.

    Of the levels of marks the most exact one counts that has at least ``SHARE`` of the text of the level that has most. All
    its elements with varying text are content, but for those inside another one and those marked as furniture as well.
    """
    _spare_wrappers(root)
    found: dict[int, list[Node]] = {}
    stack: list[tuple[Node, frozenset]] = [(root, frozenset())]
    while stack:
        n, above = stack.pop()
        if _furniture(n):
            continue
        level = _level(n)
        if level is not None and level not in above:
            found.setdefault(level, []).append(n)
            above |= {level}
        stack += [(c, above) for c in reversed(n.children)]
    for length in (_length, lambda n: sum(len(_own_text(t)) for t in _shown(n))):
        held: dict[int, list[Node]] = {}
        size: dict[int, int] = {}
        for level, nodes in found.items():
            nodes = [(n, length(n)) for n in nodes]
            nodes = [(n, k) for n, k in nodes if k]
            plain = [(n, k) for n, k in nodes if n.wraps or not n.named] or nodes
            held[level], size[level] = [n for n, _ in plain], sum(k for _, k in plain)
        if any(size.values()):
            return held[min(x for x in held if size[x] >= SHARE * max(size.values()))], True
    return [root], False


def _shown(node: Node) -> list[Node]:
    """The nodes with text of their own outside furniture."""
    found, stack = [], [node]
    while stack:
        n = stack.pop()
        if _own_text(n):
            found.append(n)
        stack += [c for c in n.children if not _furniture(c)]
    return found


def _repeated(regions: list[Node]) -> set[int]:
    """Ids of the outermost blocks of marked articles that are template in all their text."""
    found, size, stack = set(), 0, list(regions)
    while stack:
        n = stack.pop()
        for c in n.children:
            if _furniture(c):
                continue
            texts = _shown(c) if c.tag in BLOCK else []
            if texts and all(t.constant for t in texts):
                found.add(id(c))
                size += sum(len(_own_text(t)) for t in texts)
            elif c.tag not in WHOLE:
                stack.append(c)
    return found if size <= BULK * sum(len(_own_text(t)) for r in regions for t in _shown(r)) else set()


def _link_share(node: Node) -> float:
    every = sum(len(_own_text(n)) for n in _walk(node))
    linked = sum(len(_own_text(n)) for a in _walk(node) if a.tag == "a" for n in _walk(a))
    return linked / every if every else 0.0


def blocks(root: Node) -> list[str]:
    """Texts of the content blocks in page order."""
    regions, marked = _article(root)
    gone = _repeated(regions) if marked else set()
    out, line = [], []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(line)).split())
        if text:
            out.append(text)
        line.clear()

    def visit(node: Node, headings_only: bool) -> None:
        stack = [(p, headings_only) for p in reversed(node.parts)]
        while stack:
            p, only = stack.pop()
            if p is None:
                flush()
            elif isinstance(p, str):
                if not only:
                    line.append(p)
            elif p.tag == "br" or p.tag == "wbr":
                line.append(" " if p.tag == "br" else "")
            elif not _furniture(p):
                block = p.tag in BLOCK
                if id(p) in gone:
                    stack.append((None, only))
                    continue
                if not marked and block and (p.constant and not p.children or p.tag in ("ul", "ol", "div", "p")
                                             and _link_share(p) > 0.7):
                    continue
                inner = only and p.tag not in HEADINGS or p.tag == "header" or "header" in p.words and block
                if p.tag == "header" and not marked:
                    continue
                texts = [(None, inner)] if block else []
                own = p.constant and not marked and block
                parts = [(x, inner) for x in p.parts if not (own and isinstance(x, str))]
                if block:
                    stack.append((None, inner))
                stack += reversed(parts)
                stack += texts

    for region in regions:
        visit(region, False)
        flush()
    return out


def main_texts(htmls: list[str | None], wrapper: Wrapper | None = None) -> tuple[list[str], Wrapper | None]:
    """Main text of each page of one host, and the wrapper they were read with (the given one where they are too few)."""
    trees = [parse(h or "") for h in htmls]
    distinct = {hashlib.blake2b((h or "").encode("utf-8", "surrogatepass"), digest_size=16).digest(): t
                for h, t in zip(htmls, trees)}
    if len(distinct) >= LEAST:
        wrapper = Wrapper(list(distinct.values()))
    if wrapper:
        for t in trees:
            wrapper.mark(t)
    return ["\n".join(blocks(t)) for t in trees], wrapper


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: page_id, url, text (empty if none) and n_chars (its code points).

    Null and empty html has empty text; pages without a host form a group of their own. Repeated pages are read alike and count once in a
    template.
    """
    small_batches(pages.sparkSession)
    types = dict(pages.dtypes)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"),
                        host_of(F.col(url)).alias("host"))
    large = small_side(rows.groupBy(F.col("host").alias("__host")).agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("parts")).filter("parts > 1"))
    h = F.xxhash64("page_id", "url", "html")
    dealt = rows.join(large, F.col("host") == F.col("__host"), "left") \
        .withColumn("part", F.coalesce(F.pmod(h, F.col("parts")), F.lit(0).cast("long"))).drop("__host", "parts") \
        .repartitionByRange("host", "part").sortWithinPartitions("host", "part", "page_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, wrapper, held = None, None, []

        def flush() -> pd.DataFrame:
            nonlocal wrapper
            texts, wrapper = main_texts([h[2] for h in held], wrapper)
            return pd.DataFrame({"page_id": [h[0] for h in held], "url": [h[1] for h in held], "text": texts,
                                 "n_chars": [len(t) for t in texts]})

        for df in frames:
            out = []
            for p, u, page, *at in zip(df["page_id"], df["url"], df["html"], df["host"], df["part"]):
                # a part is larger than that only by rows that repeat
                if held and (at != place or len(held) >= 4 * GROUP):
                    out.append(flush())
                    held = []
                if at != place:
                    place, wrapper = at, None
                held.append((p, u, page))
            if out:
                yield pd.concat(out)
        if held:
            yield flush()

    return dealt.mapInPandas(run, f"page_id {types[page_id]}, url {types[url]}, text string, n_chars long")
