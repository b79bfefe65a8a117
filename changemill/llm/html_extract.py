"""Main text of web pages by wrapper induction.

Pages of one host are made by one program. Their DOM trees, with runs of like siblings folded into one
node, are aligned by simple tree matching into a template of the host: matched nodes count their
pages, their text and whether it is the same on all of them. Nodes of constant text are the template; the
slots whose text varies and holds the most running text are the content. Each page is aligned with its host's
template, and the blocks of its slots, without nested boilerplate, are its text. An ``article`` or ``main``
is no slot by its name: it only ends the way down. Class and id words alone drop no element that varies and
holds much of its host's text.

Each task folds its pages into one template a host, and the tasks' templates are merged in
a stream sorted by host: a host with a third of all pages costs each task one template. Templates
are as large as the kinds of page of their host, not as their number: labels leave out names with digits (a
name without any that differs on each page still makes a node each). Where siblings come in several orders, the alignment,
and with it the template, can depend on which pages a task holds.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changemill.llm.common import fresh, slices, whole
from changemill.llm.url_filter import host_of
from changemill.session import run_dir

#: Hosts whose templates a task holds before it passes them on.
MOST_HOSTS = 20_000
#: Distinct pages that must agree before text counts as constant.
AGREE = 3
#: Parts of the varying text: of slots together, of each slot, and of a named element that is kept.
SLOTS, SLOT, KEPT = 0.6, 0.2, 1 / 3

#: A comment, a declaration, or a tag, which ends at its sign or at the next tag. Nothing is given back, so a page
#: takes time in proportion to its length.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)"
    r"((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+'|[\"']|<(?![a-zA-Z/!?]))*+)(?:>|(?=<))",
    re.S,
)
#: A tag that the end of the page cuts off.
_CUT_TAG = re.compile(r"<[/a-zA-Z!?][^<>]*\Z")
_ATTRIBUTE = re.compile(r"""([^\s"'=/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"']+))?""")
_RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp")
_RAW_END = {t: re.compile(rf"</{t}[\s/>][^>]*>?|</{t}>|\Z", re.I) for t in _RAW}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
_TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th caption figcaption pre blockquote summary".split())
_CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main "
    "menu nav ol p pre section table ul".split()
)
_CLOSED_BY_LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_DROP_TAGS = frozenset(
    "nav header footer aside form script style noscript template iframe button select textarea input dialog menu svg canvas "
    "object audio video head title fieldset".split()
)
#: Words of a name that stand for boilerplate, and words that may stand beside them.
_DROP_WORDS = re.compile(
    r"ads?|advert\w*|banner|breadcrumbs?|comments?|commentlist|respond|repl(?:y|ies)|cookies?|consent|notices?|"
    r"disclaimer|footer|header|masthead|menus?|nav|navbar|navigation|newsletter|subscribe|pagination|pager|popup|modal|promo\w*|related|"
    r"recommended|share|sharing|sidebar|social|sponsor\w*|toolbar|widgets?|toc|skip",
    re.I,
)
_LAYOUT_WORDS = re.compile(
    r"\d+(?:x\d+)?|area|articles|bar|block|bottom|box|buttons?|container|content|fixed|form|global|icons?|inner|items?|js|left|links?|list|main|"
    r"outer|page|posts|primary|right|secondary|section|site|slot|sticky|stories|to|top|unit|wp|wrap|wrapper",
    re.I,
)
#: Elements that no class or id word drops.
_NEVER_NAMED = frozenset("html body article main p h1 h2 h3 h4 h5 h6".split())
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_MAIN_TAGS = ("article", "main")
#: Place of the root; a place is a hash of the labels on the way to it.
ROOT = 0


def place(above: int, label: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{above:x}/{label}")


class Node:
    """An element: its label (tag and first name, after ``!`` if its names stand for boilerplate),
    whether it is boilerplate by its kind, and its content in page order, strings and nodes."""

    __slots__ = ("boiler", "content", "label", "tag")

    def __init__(self, tag: str, label: str, boiler: bool):
        self.tag, self.label, self.boiler, self.content = tag, label, boiler, []


def attributes(text: str) -> dict[str, str]:
    """Attributes of a tag by lower-cased name; of equal names the first counts."""
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), value[1:-1] if value[:1] in ("'", '"') else value)
    return found


def steady_name(names: str) -> str:
    """The name that a label takes: the first without digits, else the words of the first that have none. Numbers
    of pages and posts would make a node of their own for each."""
    some = names.split()
    for name in some:
        if not any(c.isdigit() for c in name):
            return name.replace("/", "-")
    return "-".join(w for w in re.split("[_-]", some[0].replace("/", "-")) if w and not any(c.isdigit() for c in w))


def is_boilerplate_name(names: str) -> bool:
    """Whether one of the names is made of words for boilerplate, alone or with words for places."""

    def fits(name: str) -> bool:
        words = [w for w in re.split("[_-]", name) if w]
        drops = [bool(_DROP_WORDS.fullmatch(w)) for w in words]
        return any(drops) and all(d or _LAYOUT_WORDS.fullmatch(w) for d, w in zip(drops, words, strict=True))

    return any(map(fits, names.split()))


def parse(page: str) -> Node:
    """The element tree of a page. Ends of elements that may be left out are supplied; text of
    scripts, styles and the like is not kept."""
    root = Node("#root", "#root", False)
    stack, at, n = [root], 0, len(page)
    open_tags: Counter[str] = Counter()

    def cut(i: int) -> None:
        open_tags.subtract(x.tag for x in stack[i:])
        del stack[i:]

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            stack[-1].content.append(_CUT_TAG.sub("", page[at:]))
            break
        if m.start() > at:
            stack[-1].content.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if not open_tags[tag]:
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    cut(i)
                    break
                if tag in _INLINE and stack[i].tag not in _INLINE:
                    break  # a stray end of an inline element closes no block
            continue
        if tag in _CLOSES_P and open_tags["p"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    cut(i)
                    break
                if stack[i].tag not in _INLINE:
                    break
        like = _CLOSED_BY_LIKE.get(tag)
        if like and any(open_tags[x] for x in like):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in like:
                    cut(i)
                    break
                if stack[i].tag not in _INLINE and stack[i].tag != "p":
                    break
        if tag == "tr" or tag == "body":
            while len(stack) > 1 and stack[-1].tag in ("td", "th", "head"):
                cut(len(stack) - 1)
        names = attributes(m[3]) if m[3].strip() else {}
        name = " ".join(x for x in (names.get("class"), names.get("id")) if x and x.strip())
        boiler = tag in _DROP_TAGS or "hidden" in names or names.get("role", "").lower() in _DROP_ROLES
        named = bool(name) and tag not in _NEVER_NAMED and is_boilerplate_name(name)
        boiler = boiler or (named and tag in _INLINE)
        steady = steady_name(name) if name else ""
        node = Node(tag, ("!" if named else "") + (f"{tag}.{steady}" if steady else tag), boiler)
        stack[-1].content.append(node)
        if tag in _RAW:
            at = _RAW_END[tag].search(page, at).end()
        elif tag not in _VOID and not m[3].rstrip().endswith("/"):
            stack.append(node)
            open_tags[tag] += 1
    return root


def blocks(node: Node, dropped: frozenset[int] = frozenset(), at: int = ROOT, kept: frozenset[int] = frozenset()) -> list[str]:
    """Texts of a subtree's blocks in page order: references decoded, white space as one blank.
    Boilerplate, also by name but for ``kept`` places, and nodes at ``dropped`` places are left out."""
    out: list[str] = []
    open_: list[str] = []

    def close() -> None:
        text = " ".join(html.unescape("".join(open_)).split())
        open_.clear()
        if text:
            out.append(text)

    todo: list = [(node, at)]
    while todo:
        item, where = todo.pop()
        if item is None:
            close()
        elif isinstance(item, str):
            open_.append(item)
        elif item.tag in _INLINE:
            if item.boiler:
                continue
            if item.tag == "br":
                open_.append(" ")
            todo.extend((x, where) for x in reversed(item.content))
        else:
            close()
            here = place(where, item.label) if item is not node else where
            if item is not node and (item.boiler or here in dropped or (item.label[0] == "!" and here not in kept)):
                continue
            todo.append((None, ROOT))
            todo.extend((x, here) for x in reversed(item.content))
    close()
    return out


# ---- Templates: [label, children, constant text hash or None, text length, digests of its pages] ----
# The hash leaves out elements whose names stand for boilerplate. Of the digests, AGREE are enough.


def skeleton(root: Node) -> list:
    """A page's tree as a template of one page."""
    tree = _folded(root)
    seen, todo = [tree[2]], [tree]
    while todo:
        node = todo.pop()
        node[4] = seen
        todo.extend(node[1])
    return tree


def _folded(node: Node) -> list:
    """A subtree's template: block elements only, like siblings folded. Trees are as deep as pages make them, so
    nothing here calls itself."""
    top: list = []
    made: list[tuple[list, str, int]] = []  # every node after the one above it: template, own text
    todo: list[tuple[str, list[Node], list]] = [(node.label, [node], top)]
    while todo:
        label, like, tree = todo.pop()
        own: list[str] = []
        kids: dict[str, list[Node]] = {}
        inner: list = [x for k in reversed(like) for x in reversed(k.content)]
        while inner:
            x = inner.pop()
            if isinstance(x, str):
                own.append(x)
            elif x.tag in _INLINE:
                inner.extend(reversed(x.content))
            elif not x.boiler:
                kids.setdefault(x.label, []).append(x)
        tree[:] = [label, [[] for _ in kids], None, 0, []]
        made.append((tree, " ".join("".join(own).split())))
        todo.extend((name, some, child) for (name, some), child in zip(kids.items(), tree[1], strict=True))
    for tree, text in reversed(made):
        tree[2] = xxhash.xxh3_64_intdigest("\n".join([text, *[str(c[2]) for c in tree[1] if c[0][0] != "!"]]))
        tree[3] = len(text) + sum(c[3] for c in tree[1])
    return top


def match(a: list, b: list, memo: dict) -> int:
    """Simple tree matching: most pairs of nodes that equal labels and the order of siblings allow."""
    if a[0] != b[0]:
        return 0
    todo = [(a, b)]
    while todo:
        x, y = todo[-1]
        if (id(x), id(y)) in memo:
            todo.pop()
            continue
        unknown = [(p, q) for p in x[1] for q in y[1] if p[0] == q[0] and (id(p), id(q)) not in memo]
        if unknown:
            todo.extend(unknown)
            continue
        memo[id(x), id(y)] = 1 + _table(x[1], y[1], memo)[-1][-1]
        todo.pop()
    return memo[id(a), id(b)]


def _table(xs: list, ys: list, memo: dict) -> list[list[int]]:
    """Most pairs of the first siblings on both sides; the pairs of siblings themselves are in the memory."""
    table = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    for i, x in enumerate(xs, 1):
        for j, y in enumerate(ys, 1):
            table[i][j] = max(table[i - 1][j], table[i][j - 1], table[i - 1][j - 1] + (memo[id(x), id(y)] if x[0] == y[0] else 0))
    return table


def aligned(xs: list, ys: list, memo: dict) -> list[tuple]:
    """Siblings of two trees side by side, in order; None where one has no partner."""
    if [x[0] for x in xs] == [y[0] for y in ys]:
        return list(zip(xs, ys, strict=True))
    for x in xs:
        for y in ys:
            match(x, y, memo)
    table, i, j, out = _table(xs, ys, memo), len(xs), len(ys), []
    while i or j:
        if i and j and (pair := match(xs[i - 1], ys[j - 1], memo)) and table[i][j] == table[i - 1][j - 1] + pair:
            i, j = i - 1, j - 1
            out.append((xs[i], ys[j]))
        elif j and (not i or table[i][j] == table[i][j - 1]):
            j -= 1
            out.append((None, ys[j]))
        else:
            i -= 1
            out.append((xs[i], None))
    return out[::-1]


def merge(a: list, b: list) -> list:
    """Template of two aligned trees. A node that one lacks keeps its own counts."""
    memo: dict = {}
    top: list = []
    todo = [(a, b, top)]
    while todo:
        x, y, made = todo.pop()
        seen = x[4] if x[4] == y[4] else sorted({*x[4], *y[4]})[:AGREE]
        made[:] = [x[0], [], x[2] if x[2] == y[2] else None, x[3] + y[3], seen]
        for p, q in aligned(x[1], y[1], memo):
            if p and q:
                made[1].append([])
                todo.append((p, q, made[1][-1]))
            else:
                made[1].append(p or q)
    return top


def flat(template: list) -> list[list]:
    """A template as a list of its nodes, each before those below it, with the number of its children."""
    out, todo = [], [template]
    while todo:
        node = todo.pop()
        out.append([node[0], len(node[1]), *node[2:]])
        todo.extend(reversed(node[1]))
    return out


def grown(nodes: list[list]) -> list:
    """The template of a list of its nodes."""
    top: list = []
    holders = [top]
    for label, n, *rest in nodes:
        tree = holders.pop()
        tree[:] = [label, [[] for _ in range(n)], *rest]
        holders.extend(reversed(tree[1]))
    return top


def wrapper(template: list) -> dict:
    """Places of the content slots and of what lies above them, of constant containers in them, and of elements kept
    against their names."""
    least = KEPT * template[3]
    order: list[tuple[list, int, int]] = []  # node, its place, index of the one above
    todo = [(template, ROOT, -1)]
    while todo:
        node, where, above = todo.pop()
        order.append((node, where, above))
        for c in node[1]:
            # What its name drops is not looked into.
            if c[0][0] != "!" or not (_constant(c) or c[3] < least):
                todo.append((c, place(where, c[0]), len(order) - 1))
    kept: set[int] = set()
    weight: dict[int, int] = {}
    below, keeps = [0] * len(order), [False] * len(order)
    for i in range(len(order) - 1, -1, -1):
        node, where, above = order[i]
        own = node[3] - sum(c[3] for c in node[1])
        weight[id(node)] = 0 if _constant(node) and not keeps[i] else own + below[i]
        if node[0][0] == "!":
            kept.add(where)
            keeps[i] = True
        if above >= 0:
            below[above] += weight[id(node)]
            keeps[above] |= keeps[i]
    places = {id(node): where for node, where, _ in order}
    slots: list[list] = []
    ways: set[int] = set()
    todo = [template]
    while todo:
        node = todo.pop()
        inner = [c for c in node[1] if _tag(c) not in _TEXT_BLOCKS and weight.get(id(c))]
        big = [c for c in inner if weight[id(c)] >= SLOT * weight[id(node)]]
        if any(_tag(c) in _MAIN_TAGS for c in big) and all(_tag(c) in _MAIN_TAGS for c in big):
            big = [c for c in inner if _tag(c) in _MAIN_TAGS]
        enough = big and sum(weight[id(c)] for c in big) >= SLOTS * weight[id(node)]
        of_main = all(_tag(c) in _MAIN_TAGS for c in big)
        if _tag(node) in _MAIN_TAGS or not enough or (not of_main and (len(big) > 1 or not big[0][1])):
            slots.append(node)
        else:
            ways.add(places[id(node)])
            todo.extend(big)
    constant, varying = set(), set()
    inside = [(c, place(places[id(node)], c[0])) for node in slots for c in node[1]]
    while inside:
        c, where = inside.pop()
        if _tag(c) in _TEXT_BLOCKS:
            continue
        if _constant(c) and c[3] and not weight.get(id(c)):
            constant.add(where)
        else:
            varying.add(where)
            inside.extend((x, place(where, x[0])) for x in c[1])
    ends = sorted(places[id(node)] for node in slots)
    return {"slots": ends, "ways": sorted(ways), "constant": sorted(constant - varying), "kept": sorted(kept)}


def _constant(node: list) -> bool:
    return node[2] is not None and len(node[4]) >= AGREE


def _tag(node: list) -> str:
    return node[0].lstrip("!").partition(".")[0]


def extract(page: str, spec: dict) -> str:
    """Text of a page by its host's wrapper; a page without text in the slots by its own tree."""
    root = parse(page)
    return _text(root, spec) or _text(root, wrapper(skeleton(root)))


def _text(root: Node, spec: dict) -> str:
    dropped, kept = frozenset(spec["constant"]), frozenset(spec["kept"])
    found = _at(root, frozenset(spec["slots"]), frozenset(spec["ways"]))
    return "\n".join(b for node, where in found for b in blocks(node, dropped, where, kept))


def _at(root: Node, ends: frozenset[int], ways: frozenset[int]) -> list[tuple[Node, int]]:
    """Nodes at the places, none of which lies below another, in page order."""
    found, todo = [], [(root, ROOT)]
    while todo:
        node, where = todo.pop()
        if where in ends:
            found.append((node, where))
        elif where in ways:
            below = []
            inner = list(reversed(node.content))
            while inner:
                x = inner.pop()
                if isinstance(x, str):
                    continue
                if x.tag in _INLINE:
                    inner.extend(reversed(x.content))
                elif not x.boiler:
                    below.append((x, place(where, x.label)))
            todo.extend(reversed(below))
    return found


# ---- Spark ------------------------------------------------------------------------------------------


def templates(pages: DataFrame, host: str = "host", page: str = "html") -> DataFrame:
    """(host, spec): each host's wrapper as JSON."""
    schema = "host string, template string"

    def fold(state: dict, key: str, tree: list) -> None:
        old = state.get(key)
        state[key] = merge(old, tree) if old else tree

    def rows(state: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(state), pa.string()), pa.array([json.dumps(flat(v)) for v in state.values()], pa.string())], names=["host", "template"]
        )

    def induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches:
            hosts, at = batch.column(0).to_pylist(), 0
            for part in slices(batch.column(1)):
                for text in part.to_pylist():
                    fold(state, hosts[at], skeleton(parse(text)))
                    at += 1
                if len(state) > MOST_HOSTS:
                    yield rows(state)
                    state.clear()
        if state:
            yield rows(state)

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if state and key not in state:
                    yield specs(state)
                    state.clear()
                fold(state, key, grown(json.loads(text)))
        if state:
            yield specs(state)

    def specs(state: dict) -> pa.RecordBatch:
        found = [json.dumps(wrapper(tree)) for tree in state.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(state), pa.string()), pa.array(found, pa.string())], names=["host", "spec"])

    parts = pages.select(F.col(host).alias("host"), whole(page).alias("html")).mapInArrow(induce, schema)
    return parts.repartition("host").sortWithinPartitions("host", "template").mapInArrow(join_up, "host string, spec string")


def extract_text(df: DataFrame, url: str = "url", page: str = "html", out: str = "text") -> DataFrame:
    """``df`` with the main text of its pages in ``out``, which replaces a column of that name.

    Null or empty pages have an empty text. A URL that is null or has no host shares the template
    of all such pages. Repeated rows give repeated texts; an empty table gives an empty one.
    """
    host, spec = fresh(df, "host"), fresh(df, "spec")
    rows = df.withColumn(host, host_of(F.col(url)))
    found = templates(rows, host, page)
    path = f"{run_dir(df.sparkSession, 'wrappers')}/specs"
    found.write.parquet(path)
    found = df.sparkSession.read.schema("host string, spec string").parquet(path)
    found = found.select(F.col("host").alias(f"{host}_of"), F.col("spec").alias(spec))

    @F.arrow_udf("string")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known: dict[str, dict] = {}
        for htmls, specs in batches:
            out, names, at = [], specs.to_pylist(), 0
            for part in slices(htmls):
                for text in part.to_pylist():
                    name = names[at]
                    if name not in known:
                        if len(known) > MOST_HOSTS:
                            known.clear()
                        known[name] = json.loads(name)
                    out.append(extract(text, known[name]))
                    at += 1
            yield pa.array(out, pa.string())

    joined = rows.join(found, F.col(host) == F.col(f"{host}_of"), "left")
    return joined.withColumn(out, run(whole(page), F.col(spec))).drop(host, f"{host}_of", spec)
