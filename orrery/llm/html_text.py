"""HTML extraction by wrapper induction.

A page is read into a tree of its block elements. Of each host a bounded number of pages
(``sample``, by hash of their html, no page twice) gives skeletons: pages are aligned by simple
tree matching, those that match go to one layout, and the largest tree of a layout is its
skeleton, each node with its commonest text. Then every page of the host is aligned with its
skeleton, and it is counted for each node in how many pages it is, how often it has that text,
how much of its text is links, and which share of the page's varying text it holds. Pages that
match no skeleton of their host are sampled and aligned again, among themselves, until a host
has fewer than ``least`` of them left or gave no further layout ``tries`` times in a row: a
sample fits the layouts, but every page is given to one. From these counts, over all pages, the
wrapper of a layout is made:

* nodes of constant text are template, and slots made of links are navigation;
* the content is the smallest container that holds most of the varying text; whatever lies
  outside is left out, whatever its names, but for the page's main heading before it.

Each page is aligned with its wrapper, and the content's text is kept block by block. Elements
that HTML itself sets apart (nav, footer, aside, form and the like, roles, hidden ones) are left
out everywhere. Class names that stand for adverts, comments and so on decide alone only where
no wrapper can: on hosts of fewer than ``least`` different pages and on pages of a layout of
their own. Inside the content they set apart blocks whose text varies as the article's does
(comments, notices); what holds the page's article is never left out by a name. A slot of links
loses only text that is made of links in the page itself, and never a heading of an article.

Blocks end at block elements; ``<br>`` and inline elements do not end one. White space (as
Unicode has it) in a block is one space. Character references are decoded. Nothing is cut.

Defined results: a null or empty html gives an empty text; a page without a readable host
shares the wrapper of the empty host; ids may be null or repeated, as rows are read alone; an
empty table gives an empty result; further columns are ignored; blocks nested deeper than
DEPTH have their text in the block at that depth, each as a run of its own.
"""

from __future__ import annotations

import json
import re
import sys
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import ship, stage
from .url_filter import host_of

#: Wrappers of so many bytes in all are broadcast to the pages; more are joined by shuffle.
BROADCAST_BYTES = 8_000_000
#: Blocks nested deeper are not nodes of their own.
DEPTH = 2000
#: Of a row of siblings of the same kind in a skeleton so many are kept.
ROW = 8
#: Trees that share so much of their nodes are one layout.
ALIKE = 0.6
#: A container is left for a child that holds this share of its varying text.
MOST = 0.6
FLUSH = 2000
sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))
# Names of elements.
RAW = "script|style|noscript|template|svg|math|iframe|object|textarea|select|title|canvas|audio|video|xmp|noembed|noframes"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("caption dd dt li head html body tbody td tfoot th thead tr legend summary".split())
CLOSED_BY = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
LEFT_OUT = frozenset("nav footer aside form head menu dialog button fieldset search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
WORDS = "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pagination paywall popup promo promoted promotion recommended register related replies reply respond rss share sharing shoutbox sidebar signup skip social sponsor sponsored subscribe tags toolbar topbar widget widgets".split()
HEADER_WORDS = frozenset(("header", "site-header", "page-header"))

TOKEN = re.compile(rf"<(?:svg|math)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*/>|<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.DOTALL | re.IGNORECASE)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
SPACE = re.compile(r"\s+")
CONTAINERS = frozenset("html div section article main td tr tbody table center dd".split())
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
OUT_NAMES = frozenset(WORDS)


class Node:
    """A block element. ``parts``: its text (str) and block children, in order; ``link``: how many characters of its text are in links. ``named``: it is out by its class or id only; ``inside``: an article or main holds it."""

    __slots__ = ("tag", "kind", "out", "parts", "link", "mark", "named", "inside", "at", "slot")

    def __init__(self, tag: str, kind: str = "", out: bool = False):
        self.tag, self.kind, self.out, self.parts, self.link, self.mark, self.at, self.slot = tag, kind, out, [], 0, "", -1, None
        self.named = self.inside = False

    @property
    def children(self) -> list[Node]:
        return [x for x in self.parts if not isinstance(x, str)]

    def text(self) -> str:
        return SPACE.sub(" ", "".join(x for x in self.parts if isinstance(x, str))).strip()

    def whole(self) -> str:
        return " ".join([t] if (t := self.text()) and not self.children else [*([t] if t else []), *(c.whole() for c in self.children)])

    def links(self) -> int:
        return self.link + sum(c.links() for c in self.children)


def _stands_out(tag: str, attributes: str, inside_article: bool) -> tuple[str, bool, bool]:
    """The class and id of an element, whether its name or theirs say that it isn't part of the article, and whether only theirs do."""
    out = tag in LEFT_OUT or (tag == "header" and not inside_article)
    kind, named = "", False
    if attributes:
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id"):
                kind += " " + value
                names = {w.lower() for w in NAME.findall(value)}
                named = named or bool(names & OUT_NAMES) or (not inside_article and bool({*value.lower().split()} & HEADER_WORDS))
            elif name == "role":
                out = out or value.lower() in ROLES
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE)):
                out = True
    free = tag in ("html", "body", "article", "main")
    return kind.strip(), (out or named) and not free, named and not out and not free


def parse(html: str | None) -> Node:
    root = Node("html")
    stack: list[tuple[str, Node]] = [("html", root)]  # names of open elements and the block each is in
    links = 0
    at = 0
    in_article = 0
    html = html or ""

    def put(text: str) -> None:
        if text:
            node = stack[-1][1]
            node.parts.append(unescape(text) if "&" in text else text)
            if links:
                node.link += len(text.strip())

    def pop_to(i: int) -> None:
        nonlocal links, in_article
        for name, _ in stack[i:]:
            links -= name == "a"
            in_article -= name in ("article", "main")
        del stack[i:]

    for m in TOKEN.finditer(html):
        put(html[at : m.start()])
        at = m.end()
        name = m[3] or m[6]
        if not name:
            continue
        name = name.lower()
        if m[2] or m[5]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    pop_to(i)
                    break
                if name not in BLOCK and stack[i][0] in BLOCK:
                    break  # an inline element ends within its block
            continue
        attributes = m[4] or m[7] or ""
        if name == "br":
            put(" ")
        if name in ("html", "body"):
            if name == "body":
                pop_to(1)
            continue
        if name in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    pop_to(i)
                    break
                if stack[i][0] in BLOCK:
                    break
        if name in CLOSED_BY:
            ends, within = (x.split() for x in CLOSED_BY[name])
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in within:
                    break
                if stack[i][0] in ends:
                    pop_to(i)
                    if name != "tr":
                        break
        kind, out, named = _stands_out(name, attributes, in_article > 0)
        if name in BLOCK or out:
            if len(stack) > DEPTH and not (out and not stack[-1][1].out):
                stack[-1][1].parts.append(Node("hr"))  # deeper blocks only end the one before; their text is the parent's
                if name not in VOID:
                    stack.append((name, stack[-1][1]))
                    in_article += name in ("article", "main")
            elif name not in VOID:
                node = Node(name, kind, out)
                node.named, node.inside = named, in_article > 0
                stack[-1][1].parts.append(node)
                stack.append((name, node))
                in_article += name in ("article", "main")
            else:
                stack[-1][1].parts.append(Node(name))
        elif name not in VOID and not attributes.rstrip().endswith("/"):
            stack.append((name, stack[-1][1]))
            links += name == "a"
    put(html[at:])
    return root


def _same(a: Node, b: Node) -> bool:
    return a.tag == b.tag and (a.kind == b.kind or not a.kind or not b.kind)


def match(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching of two nodes that are the same: the size of the largest matching that keeps order and ancestors, and its pairs."""
    x, y = a.children, b.children
    pairs = [(a, b)]
    if not x or not y:
        return 1, pairs
    below: dict[tuple[int, int], tuple[int, list]] = {}
    table = [[0] * (len(y) + 1)]
    for i, p in enumerate(x, 1):
        row, last = [0], table[-1]
        for j, q in enumerate(y, 1):
            best = max(last[j], row[j - 1])
            if _same(p, q):
                below[i, j] = got = match(p, q) if p.parts and q.parts else (1, [(p, q)])
                best = max(best, last[j - 1] + got[0])
            row.append(best)
        table.append(row)
    i, j = len(x), len(y)
    while i and j:
        if (i, j) in below and table[i][j] == table[i - 1][j - 1] + below[i, j][0]:
            pairs += below[i, j][1]
            i, j = i - 1, j - 1
        elif table[i][j] == table[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return 1 + table[-1][-1], pairs


def _walk(node: Node) -> Iterator[Node]:
    yield node
    for c in node.children:
        yield from _walk(c)


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Text with at least this share of it in links is made of links.
LINKED = 0.6


def _linked(n: Node) -> bool:
    return n.link > 0 and n.link >= LINKED * len(n.text()) and not (n.inside and n.tag in HEADINGS)


def _held(node: Node) -> tuple[int, int, int]:
    """How many articles and mains, headings h1, and characters outside of links a node holds, without what is out by more than its class."""
    articles, titles = int(node.tag in ("article", "main") and not {w.lower() for w in NAME.findall(node.kind)} & OUT_NAMES), int(node.tag == "h1")
    chars = max(len(node.text()) - node.link, 0)
    for c in node.children:
        if not c.out or c.named:
            a, t, n = _held(c)
            articles, titles, chars = articles + a, titles + t, chars + n
    return articles, titles, chars


def _holds_article(node: Node, page: tuple[int, int, int]) -> bool:
    articles, titles, chars = _held(node)
    if page[0]:
        return articles == page[0]
    return titles == page[1] and chars > (0.5 if titles else 0.9) * page[2]


def short(node: Node) -> Node:
    """The node with rows of siblings of the same kind cut to ROW."""
    out = Node(node.tag, node.kind, node.out)
    out.link, out.named, out.inside = node.link, node.named, node.inside
    row = 0
    last = None
    for x in node.parts:
        if isinstance(x, str):
            out.parts.append(x)
            continue
        row = row + 1 if last is not None and (last.tag, last.kind) == (x.tag, x.kind) else 1
        last = x
        if row <= ROW:
            out.parts.append(short(x))
    return out


def numbered(node: Node) -> list[Node]:
    nodes = list(_walk(node))
    for i, n in enumerate(nodes):
        n.at = i
    return nodes


def layouts(pages: list[str], least: int) -> list[list]:
    """Skeletons of the layouts that have ``least`` pages or more, or of all where none has, as nested lists: tag, class, commonest text, children."""
    if len(pages) < least:
        return []
    trees = sorted((short(parse(p)) for p in pages), key=lambda t: -sum(1 for _ in _walk(t)))
    groups: list[tuple[Node, int, list[Counter]]] = []
    for t in trees:
        size = sum(1 for _ in _walk(t))
        for base, n, texts in groups:
            count, pairs = match(base, t)
            if 2 * count >= ALIKE * (n + size):
                for a, b in pairs:
                    texts[a.at][b.text()] += 1
                break
        else:
            groups.append((t, size, [Counter([n.text()]) for n in numbered(t)]))

    def packed(n: Node, texts: list[Counter]) -> list:
        often = texts[n.at].most_common(1)[0][0]
        return [n.tag, n.kind, often, [packed(c, texts) for c in n.children]]

    often = [g for g in groups if g[2][0].total() >= least]
    return [packed(base, texts) for base, _, texts in often or groups]


def unpacked(skeleton: list) -> Node:
    """The tree of a skeleton or wrapper; ``slot``: the commonest text; ``mark``, of wrappers: what ``decide`` gives."""
    node = Node(skeleton[0], skeleton[1])
    node.slot = skeleton[2]
    node.parts = [unpacked(c) for c in skeleton[3]]
    node.mark = skeleton[4] if len(skeleton) > 4 else ""
    return node


def _size(node: Node) -> int:
    """How many nodes ``short`` leaves of a tree."""
    n, row, last = 1, 0, None
    for c in node.children:
        row = row + 1 if last is not None and (last.tag, last.kind) == (c.tag, c.kind) else 1
        last = c
        if row <= ROW:
            n += _size(c)
    return n


def align(tree: Node, skeletons: list[Node]) -> tuple[int, list[tuple[Node, Node]], float]:
    """The skeleton that matches best, the pairs of its nodes and the tree's, and the share of both trees' nodes that are in pairs."""
    size = _size(tree)
    best = 0, [], -1.0
    for i, s in enumerate(skeletons):
        count, pairs = match(s, tree)
        alike = 2 * count / (size + sum(1 for _ in _walk(s)))
        if alike > best[2]:
            best = i, pairs, alike
    return best


def _masses(tree: Node, slots: dict[int, Node]) -> dict[int, int]:
    """Of each block, the characters of varying text under it: without links, constant text, and what its element sets apart."""
    out: dict[int, int] = {}

    def visit(n: Node) -> int:
        if n.out and not n.named:
            out[id(n)] = 0
            return 0
        text = n.text()
        slot = slots.get(id(n))
        own = 0 if slot is not None and text == slot.slot else max(len(text) - n.link, 0)
        out[id(n)] = own + sum(map(visit, n.children))
        return out[id(n)]

    visit(tree)
    return out


COUNTS = ("pages", "same", "link", "chars", "share")
PARTS = 1_000_000


def count_page(html: str, skeletons: list[Node], alike: float = 0.0) -> tuple[int, list[tuple[int, int, int, int, int]]]:
    """The layout of a page and, of each skeleton node it has: place, whether the text is the same, characters in links, characters, share of the page's varying text in PARTS. A page counts PARTS, or a copy its part of it. The layout is -1 if none is ``alike``."""
    tree = parse(html)
    which, pairs, share = align(tree, skeletons)
    if share < alike:
        return -1, []
    masses = _masses(tree, {id(n): s for s, n in pairs})
    whole = max(masses[id(tree)], 1)
    return which, [(s.at, int(bool(s.slot) and n.text() == s.slot), n.link, len(n.text()), PARTS * masses.get(id(n), 0) // whole) for s, n in pairs]


def decide(skeleton: Node, counts: np.ndarray, least: int, same: float = 0.8, linked: float = LINKED) -> list:
    """The wrapper: the skeleton with a mark for each node. "t": constant text; "l": links; "c": the content; "h": a heading before it; "x": outside of it; "": inside of it."""
    pages, alike, link, chars, share = counts.T
    least, every = least * PARTS - PARTS // 2, max(int(pages[0]), 1)  # weights of copies are rounded

    def stands(n: Node) -> str:
        if pages[n.at] < least:
            return ""
        if n.slot and alike[n.at] >= same * pages[n.at]:
            return "t"
        return "l" if link[n.at] and link[n.at] >= linked * chars[n.at] else ""

    content = skeleton
    path = [skeleton]
    while True:
        fit = [c for c in content.children if c.tag in CONTAINERS and c.children]
        best = max(fit, key=lambda c: share[c.at], default=None)
        if best is None or share[best.at] < MOST * share[content.at] or share[best.at] * 2 < share[0]:
            break
        content = best
        path.append(best)
    inside = {n.at for n in _walk(content)}
    titled = any(n.tag == "h1" for n in _walk(content))

    def packed(n: Node) -> list:
        if n is content:
            mark = "c"
        elif n.at in inside:
            mark = stands(n)
        elif n.tag == "h1" and not titled and n.at < content.at and not stands(n) and 2 * pages[n.at] >= every:
            mark = "h"
        else:
            mark = "x"
        return [n.tag, n.kind, n.slot, [packed(c) for c in n.children], mark]

    return packed(skeleton)


def extract(html: str | None, wrappers: list[Node] | None) -> list[str]:
    """The blocks of the main text."""
    tree = parse(html)
    content, headings = tree, []
    if wrappers:
        _, pairs, _ = align(tree, wrappers)
        slots = {id(n): w for w, n in pairs}
        found = next((n for w, n in pairs if w.mark == "c"), None)
        masses = _masses(tree, slots)

        def strange(n: Node) -> int:
            """Varying text in blocks that the wrapper has no place for, outside the content."""
            if n is found:
                return 0
            return masses.get(id(n), 0) if id(n) not in slots else sum(map(strange, n.children))

        if found is not None and 2 * strange(tree) <= masses[id(tree)]:
            content = found
            headings = [n for w, n in pairs if w.mark == "h"]
            for w, n in pairs:
                if w.mark == "t" and w.slot == n.text() or (w.mark == "l" and _linked(n)):
                    n.mark = w.mark
    blocks: list[str] = []
    run: list[str] = []
    page: list[tuple[int, int, int]] = []

    def left_out(n: Node) -> bool:
        if n.out and n.named:
            if not page:
                page.append(_held(tree))
            return not _holds_article(n, page[0])
        return n.out

    def flush() -> None:
        text = SPACE.sub(" ", "".join(run)).strip()
        run.clear()
        if text:
            blocks.append(text)

    def visit(n: Node) -> None:
        for x in n.parts:
            if isinstance(x, str):
                if not n.mark:
                    run.append(x)
            else:
                flush()
                if not left_out(x):
                    visit(x)
                    flush()

    for h in headings:
        visit(h)
        flush()
    visit(content)
    flush()
    return blocks


@lru_cache(256)
def _trees(text: str | None) -> list[Node] | None:
    if not text:
        return None
    trees = [unpacked(x) for x in json.loads(text)]
    for t in trees:
        numbered(t)
    return trees


def _given(pages: DataFrame, by_host: DataFrame, name: str, kind: str) -> DataFrame:
    """``pages`` with what their host has, by broadcast where that is small."""
    total = by_host.agg(F.coalesce(F.sum(F.length(name)), F.lit(0))).first()[0]
    return pages.join(F.broadcast(by_host) if total <= BROADCAST_BYTES else by_host, "host", kind)


def induce_skeletons(full: DataFrame, *, sample: int, least: int) -> DataFrame:
    """``host, skeletons`` (JSON) from ``host, html, h``."""
    nth = F.row_number().over(Window.partitionBy("host").orderBy("h"))
    few = stage(full.select("host", "h").distinct().withColumn("nth", nth).where(F.col("nth") <= sample).select("host", "h"), "sampled_pages")
    lists = few.groupBy("host").agg(F.sort_array(F.collect_list("h")).alias("hs")).withColumn("hs_text", F.array_join(F.col("hs").cast("array<string>"), ","))
    chosen = _given(full.select("host", "html", F.col("h").alias("hash")), lists, "hs_text", "inner")
    chosen = chosen.where(F.array_contains("hs", F.col("hash"))).dropDuplicates(["host", "hash"]).select("host", "html")

    def run(table: pa.Table) -> pa.Table:
        got = layouts(sorted(table.column("html").to_pylist()), least)
        return pa.table({"host": pa.array([table.column("host")[0].as_py()], pa.string()), "skeletons": pa.array([json.dumps(got) if got else None], pa.string())})

    return chosen.groupBy("host").applyInArrow(run, "host string, skeletons string").where("skeletons is not null")


def induce_wrappers(pages: DataFrame, *, sample: int, least: int, tries: int) -> DataFrame:
    """``host, wrapper`` (JSON) from ``host, html``."""
    # Pages that a host has several times weigh as one.
    full = pages.where("html is not null and html <> ''").select("host", "html", F.xxhash64("host", "html").alias("h"))
    copies = stage(full.groupBy("h").agg(F.count("*").alias("copies")).where("copies > 1"), "page_copies")
    full = full.join(F.broadcast(copies) if copies.count() <= BROADCAST_BYTES // 16 else copies, "h", "left").select("host", "html", "h", F.coalesce("copies", F.lit(1)).alias("copies"))
    rest, keys, rounds = full, None, []
    while True:
        skeletons = stage(induce_skeletons(rest, sample=sample, least=least), "skeletons")
        counted = stage(_counts(_given(rest, skeletons, "skeletons", "inner")), "counts")
        wrappers = stage(_decided(counted.where("layout >= 0"), skeletons, least), "wrappers")
        rounds.append(wrappers.select("host", F.lit(len(rounds)).alias("nth"), "wrapper"))
        # What matches no skeleton, on hosts that have enough of it and may yet give a layout.
        left = counted.where("layout < 0").select("host", "h").distinct()
        left = left.join(wrappers.select("host", F.lit(True).alias("fruitful")), "host", "left")
        if keys is not None:
            left = left.join(keys.select("host", "h", "idle"), ["host", "h"])
        idle = F.when(F.col("fruitful"), 0).otherwise((F.col("idle") if keys is not None else F.lit(0)) + 1)
        left = left.select("host", "h", idle.alias("idle")).where(F.col("idle") < tries)
        enough = left.groupBy("host").count().where(F.col("count") >= least).select("host")
        keys = stage(left.join(enough, "host"), "unlike_pages")
        n = keys.count()
        if not n:
            break
        some = keys.select("h")
        rest = full.join(F.broadcast(some) if n <= BROADCAST_BYTES // 16 else some, "h", "left_semi")
    lists = reduce(DataFrame.unionByName, rounds).groupBy("host").agg(F.sort_array(F.collect_list(F.struct("nth", "wrapper"))).alias("w"))
    inner = F.transform("w", lambda w: F.substring(w["wrapper"], F.lit(2), F.length(w["wrapper"]) - 2))
    return lists.select("host", F.concat(F.lit("["), F.array_join(inner, ","), F.lit("]")).alias("wrapper"))


def _counts(pages: DataFrame) -> DataFrame:
    """``host, layout, node`` and COUNTS, summed over all pages; pages that match no skeleton are rows of layout -1 with their ``h``."""
    schema = "host string, layout int, node int, h long, " + ", ".join(f"{c} long" for c in COUNTS)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}
        unlike: set[tuple[str, int]] = set()

        def out() -> pa.RecordBatch:
            rows = [(h, which, i, 0, *map(int, row)) for (h, which), t in held.items() for i, row in enumerate(t) if row[0]]
            rows += [(host, -1, 0, h, *[0] * len(COUNTS)) for host, h in unlike]
            held.clear()
            unlike.clear()
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), *[pa.int64()] * len(COUNTS)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)], names=["host", "layout", "node", "h", *COUNTS])

        for b in batches:
            for host, html, h, copies, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                trees = _trees(text)
                weight = PARTS // copies
                which, found = count_page(html, trees, ALIKE)
                if which < 0:
                    unlike.add((host, h))
                    if len(unlike) > 10 * FLUSH:
                        yield out()
                    continue
                if (host, which) not in held:
                    held[host, which] = np.zeros((sum(1 for _ in _walk(trees[which])), len(COUNTS)), np.int64)
                t = held[host, which]
                for at, *values, share in found:
                    t[at] += (weight, *(weight * v for v in values), weight * share // PARTS)
            if len(held) > FLUSH:
                yield out()
        yield out()

    sums = pages.select("host", "html", "h", "copies", "skeletons").mapInArrow(counted, schema)
    return sums.groupBy("host", "layout", "node", "h").agg(*[F.sum(c).alias(c) for c in COUNTS])


def _decided(counts: DataFrame, skeletons: DataFrame, least: int) -> DataFrame:
    """``host, wrapper`` (JSON) with the layouts that have ``least`` pages, for hosts that have one."""
    lists = counts.groupBy("host").agg(F.collect_list(F.struct("layout", "node", *COUNTS)).alias("counts")).join(skeletons, "host")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for rows, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                got = []
                for i, tree in enumerate(_trees(text)):
                    counts = np.zeros((sum(1 for _ in _walk(tree)), len(COUNTS)), np.int64)
                    for r in rows:
                        if r["layout"] == i:
                            counts[r["node"]] = [r[c] for c in COUNTS]
                    if counts[0, 0] >= least * PARTS - PARTS // 2:
                        got.append(decide(tree, counts, least))
                out.append(json.dumps(got) if got else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["host", "wrapper"])

    return lists.select("host", "counts", "skeletons").mapInArrow(made, "host string, wrapper string").where("wrapper is not null")


def extract_text(pages: DataFrame, *, sample: int = 24, least: int = 5, tries: int = 2, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id, url, text, blocks`` (the number of blocks) for each page."""
    ship(pages.sparkSession)
    held = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(host_of(F.col(f"`{url_col}`")), F.lit("")).alias("host"), F.col(f"`{html_col}`").alias("html"))
    wrappers = stage(induce_wrappers(held, sample=sample, least=least, tries=tries), "wrappers")
    both = _given(held, wrappers, "wrapper", "left").select("id", "url", "html", "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [extract(h.as_py(), _trees(w.as_py())) for h, w in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(["\n\n".join(x) for x in got], pa.string()), pa.array([len(x) for x in got], pa.int64())], names=["id", "url", "text", "blocks"])

    return both.mapInArrow(run, f"id {both.schema['id'].dataType.simpleString()}, url string, text string, blocks long")
