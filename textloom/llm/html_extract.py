"""Main text of web pages by wrapper induction.

Pages become trees of block elements; runs of like siblings (paragraphs, list items, elements of one class) fold into one
node, so that the tree shows the page's layout and not the length of its article. The trees of a host are aligned by
simple tree matching into one template, whose nodes gather how much text and link text they hold. Which texts recur at a
node is then counted exactly. Texts that half of the pages or more have at one node are the template's own;
the other nodes are slots. The content regions of a template are the nodes whose labels say so and that hold varying text; if no label
does, the node where the varying text lies, however much constant text others hold. The slots in one of them, and not in
one of its menus, footers, adverts, forms, comments and so on, are content; a host of several layouts has a region for each.
Pages are then aligned with their host's template and give the texts of its content slots in page order; a node that the
template lacks is what its parent is. A page that has none of the regions, as may be where hosts are unknown, is decided
by its own tree.

Layouts are counted for each task before anything is shuffled, so a host with a third of all pages costs a row a layout and
task. Layouts of a host are merged in rounds of about ``MERGE`` a task, in a tree that depends on its layouts alone, and nodes that less than one in
``RARE`` pages has leave the template, so that neither time nor size grows with the number of layouts. A page's text depends on its own host's pages only. Pages don't move while the templates are small
enough to broadcast (checked); else the hosts of most pages are broadcast and only the others' pages are shuffled.

Everything is linear in the depth of a page and done without recursion. Defined results: null and empty html give an empty
text; null urls share a host, as do urls without one; hosts of few pages have no recurring texts, nor have hosts that would keep
less than ``LEFT_HOST`` of their content without them, being copies of one article, nor has a page that would keep less than
``LEFT`` of its own and of what is usual on its host; a script or style that isn't closed hides the rest, any other
element that isn't closed hides nothing beyond its parent; repeated rows count as pages of their own; an empty table gives an
empty result; other columns never matter.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import hot_join, small_batches, written
from textloom.llm.url_filter import host_of

#: Elements (fixed values of the HTML standard) that start and end a block of text.
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page: of the first kind to the end of the page, if they aren't closed.
CODE = frozenset("script style".split())
RAW = CODE | frozenset("noscript template iframe textarea title svg".split())
#: Elements within a block whose text isn't its own.
INLINE_BAD = frozenset("button label select datalist".split())
#: Elements of the text itself, whose names are not those of a page's parts unless they are just that.
PROSE = frozenset("p li dt dd h1 h2 h3 h4 h5 h6 blockquote pre td th".split())
FOLD = frozenset("p li dt dd h1 h2 h3 h4 h5 h6 blockquote pre tr td th article".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Elements and words of class or id that mark what isn't the article.
BAD_TAGS = frozenset("head nav footer aside form menu dialog fieldset".split())
BAD_WORDS = frozenset("ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies consent gdpr notice popup modal newsletter subscribe subscription sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments reply replies respond disqus share sharing social related recommended widget login signup search pagination pager skip hidden toolbar masthead copyright".split())
COMMENT_WORDS = frozenset("comment comments reply replies respond hidden".split())
#: The words that count for elements within a block as well.
INLINE_WORDS = frozenset("ad ads advert adverts advertisement sponsor sponsored promo cookie consent newsletter hidden".split())
GOOD_WORDS = frozenset("article articlebody post entry content story main text".split())
#: A text recurs from this share of a host's pages on, which must be so many.
SHARE, MIN_PAGES = 0.5, 5
#: What a page must keep of its content without recurring texts, or of what its host's pages keep on average; and what a host must.
LEFT, LEFT_HOST = 0.5, 0.1
#: Layouts that one task merges in a round; of a leaf, and templates that a fold makes one; pages of a host of which one must have a node.
MERGE, LEAF, ARITY, RARE = 512, 64, 8, 500
#: Counts of texts, and nodes of layouts, that a task holds before it gives them out.
HELD_COUNTS, HELD_NODES = 500_000, 200_000
#: Characters of templates that may be broadcast.
BROADCAST_CHARS = 32_000_000

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)", re.S)
_PLAIN = re.compile(r"[^>\"']*")
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_MARKED = re.compile("hidden|display|" + "|".join(sorted(INLINE_WORDS)), re.I)
_NONE = re.compile(r"display\s*:\s*none", re.I)
_WORDS = re.compile(r"[A-Za-z]+")


def words_of(attributes: str, whole: bool = False) -> set[str]:
    """The words of class, id and role, of which digits don't count, and "hidden" for what isn't shown. whole: names of several words are one word
    each (share-price says nothing of sharing), and an id is a place to link to."""
    words = set()
    for name, value in _ATTR.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _NONE.search(value):
            words.add("hidden")
        elif whole and name in ("class", "role", "itemprop"):
            words.update(w for x in value.split() if (w := "".join(_WORDS.findall(x))))
        elif not whole and name in ("class", "id", "role", "itemprop"):
            words.update(_WORDS.findall(value))
    return words


def label_of(tag: str, attributes: str) -> str:
    return tag + "".join(f".{w}" for w in sorted(words_of(attributes, tag in PROSE))) if attributes else tag


class Node:
    """A node of a folded tree or template."""

    __slots__ = ("label", "children", "pages", "chars", "link_chars", "whole", "constant", "content", "constants", "typical")

    def __init__(self, label: str):
        self.label, self.children = label, []
        #: whole: characters that may be content, of all pages that have the node; constant: characters of recurring texts
        self.pages = self.chars = self.link_chars = self.whole = self.constant = 0
        #: typical (of a template): characters of varying text that a page has
        self.content, self.constants, self.typical = False, frozenset(), 0.0

    def walk(self) -> Iterator[Node]:
        """The nodes, parents before children."""
        todo = [self]
        while todo:
            x = todo.pop()
            yield x
            todo.extend(reversed(x.children))

    def depths(self) -> Iterator[tuple[int, Node]]:
        todo = [(0, self)]
        while todo:
            d, x = todo.pop()
            yield d, x
            todo.extend((d + 1, c) for c in reversed(x.children))

    def shape(self) -> str:
        out, before = [], -1
        for d, x in self.depths():
            out.append(("(" if d > before else ")" * (before - d) + ",") + x.label)
            before = d
        return "".join(out)


def _tag_end(html: str, at: int, dead: set[int]) -> int:
    """Where the > of a tag is that isn't within a quoted value, or -1. dead: places from which there is none, so that a page
    of many broken tags is looked through once."""
    seen = []
    while at not in dead:
        seen.append(at)
        q = _PLAIN.match(html, at).end()
        if q == len(html):
            break
        if html[q] == ">":
            return q
        i = q - 1
        while html[i].isspace():
            i -= 1
        if html[i] == "=":  # a quote opens a value only there
            at = html.find(html[q], q + 1) + 1
            if not at:
                break
        else:
            at = q + 1
    dead.update(seen)
    return -1


def parse(html: str | None) -> tuple[Node, list[tuple[int, str, int]]]:
    """The folded tree, and the blocks of text in page order: index of the node (in order of `Node.walk`), text, characters in links."""
    root = Node("#")
    stack: list[tuple[str, Node]] = [("#", root)]
    opened: Counter[str] = Counter()  # block elements on the stack
    skip: list[str] = []  # elements open from one on whose text isn't its block's
    skipped: Counter[str] = Counter()
    out: list[tuple[Node, str, int]] = []
    parts: list[str] = []
    links, in_link, at, html = 0, False, 0, html or ""
    last, dead, unclosed = html.rfind(">"), set(), set()

    def pop() -> None:
        opened[stack.pop()[0]] -= 1

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                if stack[-1][0] == "head":  # text ends the head
                    pop()
                out.append((stack[-1][1], text, min(links, len(text))))
            parts.clear()
        links = 0

    def take(text: str) -> None:
        nonlocal links
        if text and not skip:
            parts.append(text)
            if in_link:
                links += len(text)

    def end_skip() -> None:
        skip.clear()
        skipped.clear()

    n = len(html)
    while at < n:
        if at > last:  # no more tags
            end = html.find("<!--", at)
            take(html[at:] if end < 0 else html[at:end])
            break
        m = _TAG.search(html, at)
        if m is None:
            take(html[at:])
            break
        take(html[at : m.start()])
        if not m[2]:
            at = m.end()
            continue
        closing, tag, begin = bool(m[1]), m[2].lower(), m.end()
        end = _tag_end(html, begin, dead)
        if end < 0:
            end = html.find(">", begin)
        if end < 0:
            take(html[m.start() :])
            break
        attributes, at = html[begin:end].strip(), end + 1
        if tag in RAW:
            if not closing and not (tag == "svg" and attributes.endswith("/")) and tag not in unclosed:
                close = _ENDS[tag].search(html, at)
                if close:
                    at = close.end()
                elif tag in CODE:
                    break
                else:
                    unclosed.add(tag)
            continue
        if skip:
            block = tag in BLOCK
            if closing and skipped[tag]:
                while True:
                    gone = skip.pop()
                    skipped[gone] -= 1
                    if gone == tag:
                        break
                continue
            if block and (closing and opened[tag] or not closing and stack[-1][0] == "p" and skip[0] != "button"):
                end_skip()  # its block ends
            else:
                if not closing and tag not in VOID:
                    skip.append(tag)
                    skipped[tag] += 1
                continue
        if tag not in BLOCK and not closing and tag not in VOID and (tag in INLINE_BAD or _MARKED.search(attributes) and not INLINE_WORDS.isdisjoint(words_of(attributes))):
            skip.append(tag)
            skipped[tag] += 1
        elif tag == "a":
            in_link = not closing
        elif tag == "br":
            take(" ")
        elif tag in BLOCK:
            flush()
            in_link = False
            if closing:
                while opened[tag]:
                    gone = stack[-1][0]
                    pop()
                    if gone == tag:
                        break
            elif tag not in VOID:
                if stack[-1][0] == "p" or stack[-1][0] == "head":
                    pop()
                while stack[-1][0] in _CLOSES.get(tag, ()):
                    pop()
                up, label = stack[-1][1], label_of(tag, attributes)
                node = up.children[-1] if up.children else None
                if node is None or node.label != label or not (tag in FOLD or "." in label):
                    node = Node(label)
                    up.children.append(node)
                stack.append((tag, node))
                opened[tag] += 1
    flush()
    index = {id(x): i for i, x in enumerate(root.walk())}
    return root, [(index[id(node)], text, link) for node, text, link in out]


def _scores(a: Node, b: Node) -> dict[tuple[int, int], int]:
    """Simple tree matching: for pairs of like-labelled nodes the most pairs below them that keep parents and order."""
    memo: dict[tuple[int, int], int] = {}
    todo = [(a, b, False)] if a.label == b.label else []
    while todo:
        x, y, below = todo.pop()
        key = (id(x), id(y))
        if key in memo:
            continue
        if not below:
            todo.append((x, y, True))
            todo.extend((c, d, False) for c in x.children for d in y.children if c.label == d.label)
            continue
        row = [0] * (len(y.children) + 1)
        for c in x.children:
            new = [0]
            for j, d in enumerate(y.children):
                new.append(max(row[j + 1], new[j], row[j] + memo.get((id(c), id(d)), 0)))
            row = new
        memo[key] = row[-1] + 1
    return memo


def matching(a: Node, b: Node) -> int:
    return _scores(a, b).get((id(a), id(b)), 0)


def alignment(a: Node, b: Node) -> dict[int, Node]:
    """id(node of b) to the node of a that it is aligned with."""
    if a.shape() == b.shape():
        return {id(y): x for x, y in zip(a.walk(), b.walk(), strict=True)}
    memo, out = _scores(a, b), {}
    todo = [(a, b)] if a.label == b.label else []
    while todo:
        x, y = todo.pop()
        out[id(y)] = x
        n, m = len(x.children), len(y.children)
        table = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(1, n + 1):
            for j in range(1, m + 1):
                table[i][j] = max(table[i - 1][j], table[i][j - 1], table[i - 1][j - 1] + memo.get((id(x.children[i - 1]), id(y.children[j - 1])), 0))
        i, j = n, m
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                todo.append((x.children[i], y.children[j]))
    return out


def absorb(template: Node, tree: Node) -> None:
    """Adds a tree's figures to the nodes it is aligned with; others join the template next to their aligned siblings."""
    at = alignment(template, tree)
    todo = [(template, tree)]
    while todo:
        to, node = todo.pop()
        to.pages += node.pages
        to.chars += node.chars
        to.link_chars += node.link_chars
        to.whole += node.whole
        place = 0
        for c in node.children:
            mate = at.get(id(c))
            if mate is None:
                to.children.insert(place, c)
                place += 1
            else:
                todo.append((mate, c))
                place = next(i for i in range(place, len(to.children)) if to.children[i] is mate) + 1


def prune(template: Node, rare: int = RARE) -> None:
    """Drops the nodes that less than one in ``rare`` of the template's pages have."""
    for x in template.walk():
        if any(c.pages * rare < template.pages for c in x.children):
            x.children = [c for c in x.children if c.pages * rare >= template.pages]


def _hash(text: str) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def measure(tree: Node, blocks: list[tuple[int, str, int]]) -> None:
    """Puts one page's figures into its tree."""
    nodes = list(tree.walk())
    for i, text, links in blocks:
        nodes[i].chars += len(text)
        nodes[i].link_chars += links
    whole = masses(tree)[id(tree)]
    for x in nodes:
        x.pages, x.whole = 1, whole


def to_json(node: Node) -> str:
    return json.dumps([[d, x.label, x.pages, x.chars, x.link_chars, x.whole] for d, x in node.depths()])


def from_json(data: str) -> Node:
    path: list[Node] = []
    for d, label, *figures in json.loads(data):
        x = Node(label)
        x.pages, x.chars, x.link_chars, x.whole = figures
        if d:
            path[d - 1].children.append(x)
        del path[d:]
        path.append(x)
    return path[0]


def _bad(label: str, inside: bool) -> bool:
    tag, *words = label.split(".")
    if tag in ("html", "body", "main"):  # their classes tell what a page has, not what they are
        return False
    if not (COMMENT_WORDS if tag == "article" else BAD_WORDS).isdisjoint(words):
        return True
    return tag in BAD_TAGS or not inside and (tag == "header" or "header" in words)


def masses(tree: Node, constant: bool = True) -> dict[int, int]:
    """id(node) to the characters below it that may be content: not in menus and the like, and not mostly links; without those of
    recurring texts, if constant is False."""
    mass: dict[int, int] = {}
    for x in reversed(list(tree.walk())):
        own = 0 if x.link_chars * 2 > x.chars else x.chars - (0 if constant else x.constant)
        mass[id(x)] = 0 if _bad(x.label, True) else max(own, 0) + sum(mass[id(c)] for c in x.children)
    return mass


def regions(template: Node) -> tuple[list[Node], bool]:
    """The content regions, and whether their labels say so. Of nodes that say so and hold varying text and a quarter of the text of
    the pages that have them, the best one, and others beside it that hold half of it, which are other layouts' regions."""
    mass, varying = masses(template), masses(template, False)
    if not varying[id(template)]:  # all pages are copies of one
        varying = mass
    order = list(template.depths())
    ends: list[int] = [len(order)] * len(order)  # of each node, the place behind its last descendant
    path: list[int] = []
    for i, (d, _) in enumerate(order):
        for j in path[d:]:
            ends[j] = i
        del path[d:]
        path.append(i)
    good: list[tuple] = []
    i = 0
    while i < len(order):
        depth, node = order[i]
        if _bad(node.label, True):
            i = ends[i]
            continue
        tag, *words = node.label.split(".")
        if (tag in ("article", "main") or not GOOD_WORDS.isdisjoint(words)) and varying[id(node)] and mass[id(node)] * 4 >= node.whole:
            good.append((tag == "article" or "articlebody" in words, mass[id(node)], depth, len(good), node, i))
        i += 1
    taken: list[tuple] = []
    for g in sorted(good, key=lambda g: g[:4], reverse=True):
        apart = all(not (t[5] <= g[5] < ends[t[5]] or g[5] <= t[5] < ends[g[5]]) for t in taken)
        if not taken or apart and mass[id(g[4])] * 2 >= g[4].whole:
            taken.append(g)
    if taken:
        return [g[4] for g in taken], True
    # down to where the varying text spreads over several children
    region = template
    while region.children and (best := max(region.children, key=lambda c: varying[id(c)])) and varying[id(best)] * 10 >= 8 * varying[id(region)] and best.children:
        region = best
    return [region], False


def decide(template: Node) -> None:
    """Marks the content slots of a template whose recurring texts are known."""
    found, labelled = regions(template)
    mass, varying = masses(template), masses(template, False)
    of = [template] if not labelled else found
    total, own = (sum(m[id(x)] for x in of) for m in (mass, varying))
    if own < LEFT_HOST * total:  # copies of one article
        for x in template.walk():
            x.constants, x.constant = frozenset(), 0
        (found, labelled), own = regions(template), total
    template.typical = own / max(1, template.pages)
    todo = list(found)
    while todo:
        node = todo.pop()
        if not _bad(node.label, labelled):
            tag = node.label.split(".")[0]
            # where no label says what the article is, lists of links are menus; in an article they are references
            node.content = labelled or not (tag in ("li", "ul", "ol", "td", "div") and node.link_chars * 10 > node.chars * 7)
            todo.extend(node.children)


def slots(template: Node, tree: Node) -> list[tuple[bool, frozenset]]:
    """Of every node of a page's tree, whether it is content and what recurs there; a node that the template lacks is what its parent is."""
    at = alignment(template, tree)
    out: dict[int, tuple[bool, frozenset]] = {}
    order = []
    above: dict[int, Node] = {}
    for x in tree.walk():
        mate = at.get(id(x))
        if mate is not None:
            out[id(x)] = mate.content, mate.constants
        else:
            up = above.get(id(x))
            out[id(x)] = up is not None and out[id(up)][0] and not _bad(x.label, True), frozenset()
        for c in x.children:
            above[id(c)] = x
        order.append(out[id(x)])
    return order


def extract(template: Node, html: str | None, cache: dict[str, list] | None = None) -> list[str]:
    """The content blocks of a page."""
    tree, blocks = parse(html)
    shape = tree.shape()
    found = cache.get(shape) if cache is not None else None
    if found is None:
        found = slots(template, tree)
        if cache is not None:
            if len(cache) >= 5000:
                cache.clear()
            cache[shape] = found
    if not any(content for content, _ in found):  # a layout without any of the regions
        measure(tree, blocks)
        decide(tree)
        found = [(x.content, c) for x, (_, c) in zip(tree.walk(), found, strict=True)]
    texts = [(text, _hash(text) in found[i][1] if found[i][1] else False) for i, text, _ in blocks if found[i][0]]
    kept = [t for t, recurs in texts if not recurs]
    if sum(map(len, kept)) < LEFT * min(sum(len(t) for t, _ in texts), template.typical):  # a copy of an article, not a template's text
        kept = [t for t, _ in texts]
    return kept


_LAYOUT = "host string, shape string, layout string"


def _layouts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each host and layout of the task's pages."""
    seen: dict[tuple[str, str], Node] = {}
    nodes = 0

    def given() -> pa.RecordBatch:
        cols = [[k[0] for k in seen], [k[1] for k in seen], [to_json(v) for v in seen.values()]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["host", "shape", "layout"])

    for batch in batches:
        for host, html in zip(batch["host"], batch["html"], strict=True):
            tree, blocks = parse(html.as_py())
            measure(tree, blocks)
            key = (host.as_py(), tree.shape())
            if key in seen:
                absorb(seen[key], tree)
            else:
                seen[key] = tree
                nodes += sum(1 for _ in tree.walk())
            if nodes > HELD_NODES:
                yield given()
                seen, nodes = {}, 0
    yield given()


def folded(layouts: list[tuple[int, Node]], level: int, depth: int) -> Node:
    """One template of layouts(group, tree) that agree in the last ``level`` digits of their groups, of which there are ``depth``: digit by digit, from the
    first on. So what comes out depends on the layouts alone, however many digits one call folds."""
    if level == depth:
        trees = [x for _, x in layouts]
    else:
        by: dict[int, list[tuple[int, Node]]] = {}
        for g, x in layouts:
            by.setdefault(g // ARITY**level % ARITY, []).append((g, x))
        trees = [folded(by[g], level + 1, depth) for g in sorted(by)]
    # larger layouts first: later ones then find their mates
    template, *rest = [x for _, x in sorted(((x.shape(), x) for x in trees), key=lambda t: (-len(t[0]), t[0]))]
    for x in rest:
        absorb(template, x)
    if len(trees) > 1:
        prune(template, RARE * ARITY)
    return template


def _equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a host and shape, one after another, become one: their figures add up."""
    now, tree = None, None

    def given(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[i] for k, _ in done], pa.string()) for i in (0, 1)] + [pa.array([to_json(x) for _, x in done], pa.string())], names=["host", "shape", "layout"])

    for batch in batches:
        done = []
        for host, shape, layout in zip(*(batch[c].to_pylist() for c in ("host", "shape", "layout")), strict=True):
            if (host, shape) == now:
                absorb(tree, from_json(layout))
                continue
            if now:
                done.append((now, tree))
            now, tree = (host, shape), from_json(layout)
        if done:
            yield given(done)
    if now:
        yield given([(now, tree)])


def _templates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a host and part, one after another, become one of a lower level."""
    now, rows = None, []

    def given(done: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*done, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["host", "level", "part", "layout", "pages"])

    def one() -> tuple:
        host, part, level, depth = now
        template = folded(rows, level, depth)
        if not level:
            prune(template)
        return host, level, part, to_json(template), template.pages

    for batch in batches:
        done = []
        for host, part, to, level, group, layout in zip(*(batch[c].to_pylist() for c in ("host", "to_part", "to_level", "level", "part", "layout")), strict=True):
            if (host, part, to, level) != now:
                if now:
                    done.append(one())
                now, rows = (host, part, to, level), []
            rows.append((group, from_json(layout)))
        if done:
            yield given(done)
    if now:
        yield given([one()])


def induce(pages: DataFrame, *, merge: int | None = None) -> DataFrame:
    """(host, layout, pages): the template of every host of pages(host, html). Equal layouts become one, wherever their pages lay. A host's layouts are dealt to
    leaves of about ``LEAF`` by a hash of their shapes, as many as its own number asks for, and leaves are folded by ``ARITY`` up to the root. A round folds
    as many levels as bring about ``merge`` layouts into a task: the tree, and so the template, is the same for any ``merge``, for any number of tasks, and
    whatever other hosts there are."""
    found = pages.select("host", "html").mapInArrow(_layouts, _LAYOUT).repartition("host", "shape").sortWithinPartitions("host", "shape")
    layouts = written(found.mapInArrow(_equal, _LAYOUT), "layouts")
    # a host's own number of layouts says how deep its tree is
    depth = F.greatest(F.ceil(F.log(F.col("n") / F.lit(float(LEAF))) / F.lit(log(ARITY)) - 1e-9), F.lit(0)).cast("int")
    sizes = layouts.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    sizes = written(sizes.select("host", "n", depth.alias("level")), "hosts")
    power = lambda c: F.pow(F.lit(float(ARITY)), F.col(c)).cast("long")
    rows = hot_join(layouts, sizes, "host", "n", F.xxhash64("shape")).withColumn("part", F.pmod(F.xxhash64("shape"), power("level"))).select("host", "level", "part", "layout")
    step = max(1, int(log(max(1.0, (merge or MERGE) / LEAF), ARITY) + 1e-9))
    while True:
        deep = sizes.agg(F.max("level")).first()[0]
        lower = rows.withColumn("to_level", F.greatest(F.col("level") - step, F.lit(0))).withColumn("to_part", F.pmod("part", power("to_level")))
        dealt = lower.repartition("host", "to_part").sortWithinPartitions("host", "to_part", "part", "layout")
        rows = written(dealt.select("host", "to_part", "to_level", "level", "part", "layout").mapInArrow(_templates, "host string, level int, part long, layout string, pages long"), "templates")
        if not deep or deep <= step:
            return rows.select("host", "layout", "pages")
        # what is at the root stays as it is: folding one template changes nothing
        sizes = sizes.withColumn("level", F.greatest(F.col("level") - step, F.lit(0)))
        rows = rows.drop("pages")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of the task's pages have a text at a node of their template; text -1 stands for pages that have the node."""
    known: dict[str, tuple[Node, dict[str, list[int]]]] = {}
    held: dict[tuple[str, int, int], list[int]] = {}

    def given() -> pa.RecordBatch:
        cols = [pa.array([k[i] for k in held], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int64()))]
        figures = [pa.array([v[i] for v in held.values()], pa.int64()) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([*cols, *figures], names=["host", "node", "text", "n", "chars"])

    for batch in batches:
        for host, layout, html in zip(batch["host"].to_pylist(), batch["layout"].to_pylist(), batch["html"], strict=True):
            if layout not in known:
                if len(known) >= 2000:
                    known.clear()
                known[layout] = (from_json(layout), {})
            template, cache = known[layout]
            tree, blocks = parse(html.as_py())
            shape = tree.shape()
            if shape not in cache:
                if len(cache) >= 5000:
                    cache.clear()
                at = alignment(template, tree)
                place = {id(x): i for i, x in enumerate(template.walk()) if x.pages >= MIN_PAGES and not _bad(x.label, True)}
                cache[shape] = [place.get(id(at.get(id(x))), -1) for x in tree.walk()]
            nodes = cache[shape]
            seen = {(host, i, -1): 0 for i in nodes if i >= 0} | {(host, nodes[i], _hash(text)): len(text) for i, text, _ in blocks if nodes[i] >= 0}
            for key, chars in seen.items():
                held.setdefault(key, [0, chars])[0] += 1
            if len(held) > HELD_COUNTS:
                yield given()
                held.clear()
    yield given()


def recurring(met: DataFrame) -> DataFrame:
    """(host, constants): JSON of [node, text hash, characters on all pages] of what recurs, of pages met(host, layout, html)."""
    n = met.select("host", "layout", "html").mapInArrow(_counts, "host string, node int, text long, n long, chars long").groupBy("host", "node", "text").agg(F.sum("n").alias("n"), F.max("chars").alias("chars"))
    n = written(n.where(f"text = -1 or n >= {SHARE * MIN_PAGES}"), "counts")
    of = n.where((F.col("text") == -1) & (F.col("n") >= MIN_PAGES)).select("host", "node", F.col("n").alias("pages"))
    own = n.where("text <> -1").join(of, ["host", "node"]).where(F.col("n") >= F.col("pages") * SHARE)
    return own.groupBy("host").agg(F.to_json(F.sort_array(F.collect_list(F.array(F.col("node").cast("long"), "text", F.col("n") * F.col("chars"))))).alias("constants"))


def decided(layout: str, constants: str | None) -> Node:
    """A host's template with its recurring texts and content slots."""
    template = from_json(layout)
    nodes = list(template.walk())
    for i, text, chars in json.loads(constants or "[]"):
        nodes[i].constants |= {text}
        nodes[i].constant += chars
    decide(template)
    return template


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[tuple[str, str | None], tuple[Node, dict]] = {}
    for batch in batches:
        texts = []
        for layout, constants, html in zip(batch["layout"], batch["constants"], batch["html"], strict=True):
            key = layout.as_py(), constants.as_py()
            if key not in known:
                if len(known) >= 2000:
                    known.clear()
                known[key] = (decided(*key), {})
            texts.append(" ".join(extract(known[key][0], html.as_py(), known[key][1])))
        yield pa.RecordBatch.from_arrays([batch["row"], pa.array(texts, pa.string())], names=["row", "text"])


def _met(rows: DataFrame, templates: DataFrame, *cols: str) -> DataFrame:
    """Pages with their host's template. Of the templates those of most pages, as many as may be broadcast, meet their pages where these
    lie; only the pages of the other hosts, of which each has few, are shuffled."""
    sizes = [0, *(100 * 10**i for i in range(10))]
    length = sum((F.length(c) for c in cols), F.lit(0))
    chars = templates.agg(*[F.sum(F.when(F.col("pages") > s, length)) for s in sizes]).first()
    size = next((s for s, c in zip(sizes, chars, strict=True) if (c or 0) <= BROADCAST_CHARS), sizes[-1])
    large = F.broadcast(templates.where(F.col("pages") > size).drop("pages"))
    if not size:
        return rows.join(large, "host")
    rest = rows.join(large.select("host"), "host", "left_anti").join(templates.where(F.col("pages") <= size).drop("pages"), "host")
    return rows.join(large, "host").unionByName(rest)


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.struct(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).alias("row"), host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html"))
    templates = induce(rows)
    counted = recurring(_met(rows, templates, "layout"))
    templates = written(templates.join(counted, "host", "left").withColumn("constants", F.coalesce("constants", F.lit("[]"))), "templates")
    row = rows.schema["row"].dataType.simpleString()
    out = _met(rows, templates, "layout", "constants").select("row", "layout", "constants", "html").mapInArrow(_extracted, f"row {row}, text string")
    return out.select("row.*", "text", F.length("text").cast("long").alias("n_chars"))
