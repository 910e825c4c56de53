"""Operator 9, HTML extraction by wrapper induction.

Pages of one host are aligned by simple tree matching: the trees of their
block elements, with runs of like siblings taken as one node, are merged
into one template per host.  A node whose text is the same on all its pages
is constant and belongs to the template; a node whose text varies, or that
some pages lack, is a slot.
The wrapper is the path to the lowest node that holds all the host's slots
with plain text outside links, or to the article or main element that does;
menus, forms, notices and the like are no slots unless they hold most of the
host's varying text, or its only article or main element; reader comments and
adverts are none if there is any other slot.  A page's text is read from
the nodes that its tree aligns with the wrapper's (several if the node
repeats), in page order and whole but for constant nodes before the first or
after the last slot of a level, and constant nodes beside the child that holds
most of the slot text.

Templates are merged in each task first (one row per host and flush), then
per host as a stream, so a host with a third of all pages never gathers in
one task.  Memory is bounded by ``HOSTS_HELD`` templates in the first step
and by one host's template in the second.  A template has at most
MOST_CHILDREN nodes below each of its nodes (beyond, those of the fewest pages
become one varying node) and DEPTH levels (what lies deeper is text of the
node above, read whole).

Defined cases: a null or empty page has no text; a page without the
wrapper's node (or a host with no text outside links) is read from its
article and main elements, else its body; a host whose pages are all alike is
read as one page is, all its nodes being slots; a null URL or one without a host makes a host of its
own (empty); repeated rows and null ids are kept; unclosed and stray tags
are mended; a cut-off page is read up to its end; elements may nest to any
depth and pages be of any length; extra columns are not read and may have the
names of the result's or of this module's; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import sys

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .arrays import to_workers
from .store import keep
from .urls import host_of

# Element names and class words with a known role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg select button".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul""".split())
NO_TEXT = frozenset("head script style noscript iframe template svg select button textarea title".split())
CHROME = frozenset("nav footer aside form dialog menu search".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
CHROME_WORDS = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies
disclaimer disqus footer menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted related replies
respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets""".split())
#: Words that leave a class or id the name of furniture if they stand beside one of its words.
CHROME_PARTS = frozenset("""area articles bar bars block body bottom box btn button buttons col column container desktop first foot form global group
header holder icon icons inner item items left link links list main media message mobile page panel placeholder post posts primary right row second
secondary section site slot small space stories text this title top unit wrap wrapper zone""".split())
#: Of these, the words that never name content beside other content.
NEVER = frozenset("""ad ads advert adverts advertisement advertising comment comments consent cookie cookies disqus newsletter popup promo promoted replies
respond share sharing social sponsor sponsored subscribe signup""".split())
CLOSES_P = BLOCK - frozenset("body html head li dd dt td th tr tbody thead tfoot summary figcaption".split())
#: An open element of the key's kind ends where one of the kind begins, up to the nearest element named last.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}),
            "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"})}
MAIN = ("article", "main")

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

#: Templates that a task holds before it emits them.
HOSTS_HELD = 2000
#: Levels of a template, and nodes below one of its nodes.
DEPTH, MOST_CHILDREN = 100, 200
#: Signs of the nodes that stand for several: content and furniture.
MANY, MANY_CHROME = "*", "~*"
#: Beside a child that holds this part of a node's slot text, constant nodes are left out.
MAIN_PART = 0.8


class Node:
    """An element: tag, signature (tag and class words, ~ before furniture, ~! before comments and adverts), whether it looks like page
    furniture, children (nodes and strings).

    ``alone``: no article or main element is open around it.
    """

    __slots__ = ("tag", "sign", "chrome", "children")

    def __init__(self, tag: str, attributes: str = "", alone: bool = False):
        self.tag, self.children = tag, []
        names, role = [], ""
        if attributes and "=" in attributes:
            for kind, *values in ATTRIBUTE.findall(attributes):
                value = "".join(values).lower()
                if kind.lower() == "role":
                    role = value.strip()
                else:
                    names += value.split()
        named = tag not in MAIN and any(map(furniture, names))
        self.chrome = tag not in ("body", "html") and (tag in CHROME or role in CHROME_ROLES or named or tag == "header" and alone)
        never = named and any(furniture(n) and not NEVER.isdisjoint(re.split(r"[-_\d]+", n)) for n in names)
        self.sign = "~" * self.chrome + "!" * never * self.chrome + ".".join([tag, *sorted(n for n in names if not re.search(r"\d", n))])


def furniture(name: str) -> bool:
    """Whether a whole class or id names page furniture: all its words do, or stand beside one that does."""
    words = {w for w in re.split(r"[-_\d]+", name) if w}
    return not words.isdisjoint(CHROME_WORDS) and words <= CHROME_WORDS | CHROME_PARTS


def parse(page: str) -> Node:
    """The element tree of a page; the root holds what stands outside <html> too."""
    root = Node("#root")
    stack, at, n = [root], 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            stack[-1].children.append(page[at:])
            break
        if m.start() > at:
            stack[-1].children.append(page[at:m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            close(stack, tag)
            continue
        if tag in ("html", "head", "body") and any(x.tag == tag for x in stack):
            continue
        if tag in CLOSES_P and any(x.tag == "p" for x in stack):
            close(stack, "p")
        if tag in SIBLINGS:
            like, inside = SIBLINGS[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in inside:
                    break
                if stack[k].tag in like:
                    del stack[k:]
                    break
        if tag == "body" and stack[-1].tag == "head":
            stack.pop()
        node = Node(tag, m[3], tag == "header" and not any(x.tag in MAIN for x in stack))
        stack[-1].children.append(node)
        if tag in RAW and tag not in ("svg", "template", "select", "button", "noscript"):
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.I).search(page, at)
            at = end.end() if end else n  # what is inside is no markup and no text
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            stack.append(node)
    return root


def close(stack: list[Node], tag: str) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag == tag:
            del stack[k:]
            return
        if stack[k].tag in ("td", "th", "table") and tag not in ("tr", "table", "tbody", "thead", "tfoot", "body", "html"):
            return


def blocks(node: Node, out: list[list[str]], path: tuple[str, ...], drop: frozenset, kept: frozenset) -> None:
    """Append the text pieces under a node to ``out``, a list per block.

    ``path`` leads to the node, the paths in ``drop`` to what is left out, those in ``kept`` to furniture that is content.
    """
    ways = [(iter(node.children), path, False)]
    while ways:
        children, at, block = ways[-1]
        x = next(children, None)
        if x is None:
            ways.pop()
            if block:
                out.append([])
            continue
        if isinstance(x, str):
            out[-1].append(x)
            continue
        if x.tag in BLOCK:
            out.append([])
        way = (*at, x.sign) if apart(x) and len(at) < DEPTH else at
        if x.tag == "br":
            out[-1].append(" ")
        elif x.tag not in NO_TEXT and (not x.chrome or way in kept) and (way is at or way not in drop):
            ways.append((iter(x.children), way, x.tag in BLOCK))
            continue
        if x.tag in BLOCK:
            out.append([])


def apart(node: Node) -> bool:
    """Whether an element is a node of its own in templates."""
    return (node.tag in BLOCK or node.chrome) and node.tag not in NO_TEXT


def text_of(nodes: list[tuple[Node, tuple[str, ...]]], drop: frozenset, kept: frozenset) -> str:
    """Blocks of the nodes (each with its path) joined by line ends; references decoded, white space runs in a block made one space."""
    out: list[list[str]] = []
    for node, path in nodes:
        out.append([])
        blocks(node, out, path, drop, kept)
    return "\n".join(t for b in out if b and (t := " ".join(html.unescape("".join(b)).split())))


# A template node is a list: signature, pages, plain characters, link characters, digest of the text (None: it varies), children.
SIGN, PAGES, PLAIN, LINKS, TEXT, CHILDREN = range(6)


def skeleton(node: Node, depth: int = 0) -> list:
    """The tree of a page's block elements and furniture, runs of like siblings as one; at DEPTH all below is text."""
    text, links, children = [], 0, []
    ways = [(iter(node.children), False)]
    while ways:
        below, in_link = ways[-1]
        y = next(below, None)
        if y is None:
            ways.pop()
        elif isinstance(y, str):
            if y.strip():
                text.append(y.strip())
                links += len(y.strip()) if in_link else 0
        elif apart(y) and depth < DEPTH:
            s = skeleton(y, depth + 1)
            if children and children[-1][SIGN] == s[SIGN]:
                children[-1] = one_page(merge(children[-1], s))
            else:
                children.append(s)
        elif y.tag not in NO_TEXT and not y.chrome:
            ways.append((iter(y.children), in_link or y.tag == "a"))
    own = sum(map(len, text))
    return [node.sign, 1, own - links, links, hashlib.blake2b(" ".join(text).encode(errors="replace"), digest_size=8).hexdigest() if own else "", bounded(children)]


def bounded(children: list) -> list:
    """At most MOST_CHILDREN nodes: beyond, all but half as many, of the most pages, become one varying node (and one of furniture)."""
    if len(children) <= MOST_CHILDREN:
        return children
    order = sorted((i for i, c in enumerate(children) if c[SIGN] not in (MANY, MANY_CHROME)), key=lambda i: (-children[i][PAGES], i))
    stay = set(order[:MOST_CHILDREN // 2])
    out = [c for i, c in enumerate(children) if i in stay]
    for sign in (MANY, MANY_CHROME):
        rest = [c for i, c in enumerate(children) if i not in stay and (c[SIGN][0] == "~") == (sign == MANY_CHROME)]
        if rest:
            plain, links = ([sum_of(c, k) for c in rest] for k in (PLAIN, LINKS))
            out.append([sign, max(c[PAGES] for c in rest), sum(plain), sum(links), None, []])
    return out


def sum_of(t: list, k: int) -> int:
    return t[k] + sum(sum_of(c, k) for c in t[CHILDREN])


def one_page(t: list) -> list:
    """Makes a template of like siblings of one page count as one page, all its nodes too."""
    t[PAGES] = 1
    for c in t[CHILDREN]:
        if c[PAGES] > 1:
            one_page(c)
    return t


def _table(a: list, b: list) -> tuple[list[list[int]], list[list[int]]]:
    """Simple tree matching of two child lists: nodes matched by the best alignment from each place on, and by each pair."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    same = [[weight(x, y) if x[SIGN] == y[SIGN] else 0 for y in b] for x in a]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + same[i][j])
    return best, same


def weight(a: list, b: list) -> int:
    """Nodes that two trees with like roots have in common."""
    x, y = a[CHILDREN], b[CHILDREN]
    if [c[SIGN] for c in x] == [c[SIGN] for c in y]:
        return 1 + sum(weight(c, d) for c, d in zip(x, y))
    return 1 + _table(x, y)[0][0][0]


def align(a: list, b: list) -> list[tuple[int | None, int | None]]:
    """The pairs, in order, of an alignment of two child lists with the most matched nodes."""
    if [x[SIGN] for x in a] == [x[SIGN] for x in b]:
        return [(i, i) for i in range(len(a))]
    best, same = _table(a, b)
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and same[i][j] and best[i][j] == best[i + 1][j + 1] + same[i][j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and best[i][j] == best[i + 1][j]:
            out.append((i, None))
            i += 1
        else:
            out.append((None, j))
            j += 1
    return out


def merge(a: list, b: list) -> list:
    """The template of two templates (or skeletons) with like roots."""
    children = []
    for i, j in align(a[CHILDREN], b[CHILDREN]):
        children.append(b[CHILDREN][j] if i is None else a[CHILDREN][i] if j is None else merge(a[CHILDREN][i], b[CHILDREN][j]))
    text = a[TEXT] if a[TEXT] == b[TEXT] else None
    return [a[SIGN], a[PAGES] + b[PAGES], a[PLAIN] + b[PLAIN], a[LINKS] + b[LINKS], text, bounded(children)]


def slot_text(t: list, pages: int, path: tuple[str, ...] = (), kept: set | None = None) -> int:
    """Plain characters of a template's slots: nodes whose text varies or that some pages lack, and all nodes if the host has one page.

    With ``kept``, furniture counts only at those paths; ``path`` leads to t.
    """
    if kept is not None and t[SIGN][0] == "~" and path not in kept:
        return 0
    own = t[PLAIN] if t[TEXT] is None or t[PAGES] < pages or pages < 2 else 0
    return own + sum(slot_text(c, pages, (*path, c[SIGN]), kept) for c in t[CHILDREN])


def content_furniture(template: list, pages: int) -> set[tuple[str, ...]]:
    """Paths of what looks like furniture but holds most of the slot text, or the main article or main element.

    Comments and adverts are content only where nothing else varies.
    """
    total, kept, marked = slot_text(template, pages), set(), []
    other = slot_text(template, pages, (), set())

    def look(t: list, path: tuple[str, ...], around: tuple, never: bool) -> None:
        own = slot_text(t, pages)
        if t[SIGN][0] == "~" and t[SIGN] != MANY_CHROME:
            around, never = (*around, path), never or t[SIGN][:2] == "~!"
            if 2 * own > total and not (never and other):
                kept.add(path)
        if own and t[SIGN].split(".")[0] in MAIN and not (never and other):
            marked.append((not around, own, around))
        for c in t[CHILDREN]:
            look(c, (*path, c[SIGN]), around, never)

    look(template, (), (), False)
    return kept.union(max(marked)[2] if marked else ())


def wrapper(template: list) -> dict:
    """path: signatures on the way to the main node, the lowest that holds all slots (or the article or main element above it).

    The way may lead on by children that hold most of the slot text; ``drop``
    has the paths of the template's nodes that hold no slot and stand beside
    it, or before the first or after the last slot of their level, and
    ``kept`` those of furniture that is content.
    """
    pages = template[PAGES]
    # furniture is not content for being all that varies on pages that are alike
    kept = content_furniture(template, pages if slot_text(template, pages, (), set()) else 1)
    pages = pages if slot_text(template, pages, (), kept) else 1
    node, path, top, drop = template, (), None, []
    while (whole := slot_text(node, pages, path, kept)) and node[SIGN].split(".")[0] not in MAIN:
        inside = [(slot_text(c, pages, (*path, c[SIGN]), kept), c) for c in node[CHILDREN]]
        most, child = max(inside, key=lambda x: x[0], default=(0, None))
        descends = most >= MAIN_PART * whole and child[CHILDREN]
        slots = {c[SIGN] for n, c in inside if n}
        if descends and most < whole and top is None:
            top = path
        there = [i for i, (n, _) in enumerate(inside) if n]
        if descends and top is not None:
            drop += [(*path, c[SIGN]) for _, c in inside if c[SIGN] not in slots]
        elif there and whole == sum(n for n, _ in inside):  # no slot in the node's own text, of which the place isn't known
            drop += [(*path, c[SIGN]) for i, (_, c) in enumerate(inside) if c[SIGN] not in slots and not there[0] < i < there[-1]]
        if not descends:
            break
        node, path = child, (*path, child[SIGN])
    return {"path": (path if top is None else top) if whole else None, "drop": sorted(set(drop)), "kept": sorted(kept)}


def page_text(root: Node, wrapper: dict) -> str:
    """The text of the nodes that align with the main node, in page order; else of the article and main elements, the body or the root."""
    path, drop, kept = wrapper["path"], frozenset(map(tuple, wrapper["drop"])), frozenset(map(tuple, wrapper["kept"]))
    if path is not None:
        at = [root]
        for sign in path:
            at = [y for x in at for y in inside(x) if y.sign == sign]
        if at:
            return text_of([(x, tuple(path)) for x in at], drop, kept)
    for tags in (MAIN, ("body",)):
        if found := list(walk(root, (), tags)):
            return text_of(found, drop, kept)
    return text_of([(root, ())], drop, kept)


def inside(node: Node):
    """The elements below a node that are nodes of templates, with no other such element between."""
    ways = [iter(node.children)]
    while ways:
        x = next(ways[-1], None)
        if x is None:
            ways.pop()
        elif isinstance(x, Node):
            if apart(x):
                yield x
            elif x.tag not in NO_TEXT:
                ways.append(iter(x.children))


def walk(node: Node, path: tuple[str, ...], tags: tuple[str, ...]):
    """The outermost elements with one of the tags that are no furniture, in page order, with their paths."""
    ways = [(iter(node.children), path)]
    while ways:
        x = next(ways[-1][0], None)
        if x is None:
            ways.pop()
        elif isinstance(x, Node):
            way = (*ways[-1][1], x.sign) if apart(x) and len(ways[-1][1]) < DEPTH else ways[-1][1]
            if x.tag in tags and not x.chrome:
                yield x, way
            elif not x.sign.startswith("~!"):
                ways.append((iter(x.children), way))


def _induce(batches):
    """(host, template) of the pages of a task, merged per host."""
    held: dict[str, list] = {}

    def out():
        return pa.record_batch({"host": pa.array(list(held), pa.string()), "pages": pa.array([t[PAGES] for t in held.values()], pa.int64()),
                                "template": pa.array([json.dumps(t) for t in held.values()], pa.string())})

    for batch in batches:
        pages = arrays.filled(batch["html"])
        for host, page in zip(arrays.filled(batch["host"]).to_pylist(), pages):
            t = skeleton(parse(page.as_py()))
            t[PAGES] = int(bool(t[TEXT] or t[CHILDREN]))  # an empty page lacks no node
            held[host] = merge(held[host], t) if host in held else t
            if len(held) >= HOSTS_HELD:
                yield out()
                held.clear()
    if held:
        yield out()


def _fold(batches):
    """Templates sorted by host: one wrapper per host."""
    at, whole = None, None
    done: list[tuple[str, str]] = []
    for batch in batches:
        for host, template in zip(batch["host"].to_pylist(), batch["template"].to_pylist()):
            t = json.loads(template)
            if host != at:
                if at is not None:
                    done.append((at, json.dumps(wrapper(whole))))
                at, whole = host, t
            else:
                whole = merge(whole, t)
        if done:
            yield pa.record_batch({"host": pa.array([d[0] for d in done]), "path": pa.array([d[1] for d in done])})
            done = []
    if at is not None:
        yield pa.record_batch({"host": pa.array([at]), "path": pa.array([json.dumps(wrapper(whole))])})


def induce(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One wrapper per host: host, path (the wrapper as JSON)."""
    host = F.coalesce(host_of(F.col(url_col)), F.lit(""))
    parts = pages.select(host.alias("host"), F.col(html_col).alias("html")).mapInArrow(_induce, "host string, pages long, template string")
    parts = keep(parts, "host-templates").repartition("host").sortWithinPartitions("host", F.desc("pages"), "template")
    return keep(parts.mapInArrow(_fold, "host string, path string"), "wrappers")


def _extract(batches):
    for batch in batches:
        out = []
        paths = batch["path"].to_pylist()
        for path, page in zip(paths, arrays.filled(batch["html"])):
            out.append(page_text(parse(page.as_py()), json.loads(path) if path else {"path": None, "drop": [], "kept": []}))
        yield pa.record_batch({"id": batch["id"], "url": batch["url"], "text": pa.array(out, pa.string()), "n_chars": pa.array(list(map(len, out)), pa.int64())})


#: Wrappers are broadcast up to this many bytes; beyond, the pages are shuffled to them.
BROADCAST_BYTES = 10 << 20


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text (the main text, empty if none), n_chars."""
    wrappers = induce(pages, url_col=url_col, html_col=html_col)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    host = F.coalesce(host_of(F.col("url")), F.lit(""))
    if (wrappers.agg(F.sum(F.octet_length("host") + F.octet_length("path"))).first()[0] or 0) <= BROADCAST_BYTES:
        wrappers = F.broadcast(wrappers)
    met = rows.withColumn("host", host).join(wrappers, "host", "left").select("id", "url", "html", "path")
    out = met.mapInArrow(_extract, f"id {dict(rows.dtypes)['id']}, url string, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})


to_workers(sys.modules[__name__])
