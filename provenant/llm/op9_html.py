"""Main text of web pages by wrapper induction.

Pages of a host share a template.  Each page is a tree of labels (tag, class or id
without numbers; repeated neighbouring siblings are folded into one).  The trees of
a host are merged into its wrapper, one by one, by simple tree matching: matched
nodes become one slot, others are inserted in order.  Every different tree takes
part; merging starts in `BUCKETS` parts a host, so that a hot host isn't one task's.
Aligned with the wrapper again, each text of a page lies in a slot, and is counted
there over all different pages of the host (copies of one main text are one page).
A text that stays the same in its slot on most pages is template; slots whose texts
vary are content.  The content region is the deepest slot that holds nearly all of
the host's varying text that isn't linked.

What varies need not be article: menus and adverts differ from page to page too,
but they lie outside of the region.  Markup (article, main, content classes)
settles how far an article reaches where it agrees with the region, that is where
one lies inside the other; where it doesn't, the region decides; and it decides alone on
hosts with fewer than `MIN_PAGES` different pages, where nothing can be learnt.  Inside an
article whole class names, roles and tags that leave no doubt are dropped (ids of
headings and sections come from their titles), and what is template on nearly
every page of a host with many.

Defined cases: null or empty html gives an empty text; a null url is a host of its
own, ''; pages alone on their host have no template; repeated rows are pages,
but count once for the template; very long pages and wide lists are folded first, and beyond
`WIDE` pairs of siblings those of one label are matched in order; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .html_tree import Node, parse
from .session import durable, lean

#: A text is template in a slot if on this share of at least MIN_PAGES pages of the host.
TEMPLATE_SHARE, MIN_PAGES = 0.5, 4
#: Inside a marked article: much stricter, as articles get copied.
ARTICLE_SHARE, ARTICLE_PAGES = 0.9, 20
#: Share of a host's varying text without links that its content region holds at least.
REGION_SHARE = 0.7
#: Parts in which the trees of a host are merged at first.
BUCKETS = 64
#: Pairs of siblings beyond which they aren't compared each with each.
WIDE = 2500
#: Bytes of all wrappers together that may be broadcast (counted first).
SHARE_BYTES = 8 << 20

_SKIP_TAGS = frozenset("head nav footer aside form select button dialog menu title search fieldset legend option optgroup canvas object video audio map label".split())
_SKIP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form status tablist".split())
_SKIP_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar sidebars side aside widget widgets notice notices notification alert cookie cookies consent gdpr banner ad ads adv advert adverts advertisement "
    "adsense advertising sponsor sponsored sponsors promo promotion promoted comment comments commentlist replies reply respond disqus share sharing social related recommended recommendations newsletter subscribe subscription signup "
    "login popup modal overlay search pagination pager toolbar masthead topbar disclaimer paywall skip toc copyright legal discussion feedback reviews".split()
)
#: Inside an article: whole names that leave no doubt; other words may be a topic of its own.
_SURE = frozenset(
    "comments comment comment-list commentlist comments-area comments-section comment-section comment-form respond disqus disqus_thread disqus-thread ad ads advert adverts advertisement adsbygoogle ad-slot ad-container "
    "ad-wrapper ad-unit ad-banner sponsored sponsored-content related-posts related-articles related-links related-stories related-content recommended-posts recommended-articles recommendations share-buttons share-bar "
    "share-links sharing-buttons social-share social-sharing social-links social-buttons newsletter-signup newsletter-form subscribe-form signup-form breadcrumb breadcrumbs pagination pager navbar sidebar cookie-notice cookie-banner "
    "cookie-consent consent-banner paywall skip-link post-navigation".split()
)
#: Of a section only these ids; others are made from its title.
_SURE_SECTIONS = frozenset("comments respond disqus_thread".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_HEAD_WORDS = frozenset("header head topbar masthead".split())
_CONTENT_WORDS = frozenset("content article post entry story main maincontent articlebody postbody body".split())
_STRONG = frozenset("article-body article-content post-content post-body entry-content story-body main-content articlebody article-text content-body".split())
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@lru_cache(maxsize=1 << 14)
def _words(names: str) -> frozenset[str]:
    # has-sidebar and the like tell of the page's layout, not of the node.
    parts = " ".join(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", x).lower() for x in names.split() if not re.match(r"(?:has|with|no|without|js)[-_]", x))
    return frozenset(re.split(r"[^a-z0-9]+", parts))


def _names(node: Node) -> str:
    return f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}" if node.attrs else ""


def _is_article(node: Node) -> bool:
    return node.tag == "article" or node.attrs.get("role") == "article" or "articleBody" in node.attrs.get("itemprop", "")


def skipped(node: Node, inside: bool) -> bool:
    """Whether markup says that the node is no part of an article; inside: of one found."""
    if node.tag in _SKIP_TAGS or node.tag == "header" and not inside:
        return True
    if not node.attrs:
        return False
    a = node.attrs
    if "hidden" in a or a.get("aria-hidden") == "true" or _HIDDEN.search(a.get("style", "")):
        return True
    role = a.get("role", "")
    if role in _SKIP_ROLES and not (inside and role == "banner"):
        return True
    if node.tag in ("body", "html", "main"):
        return False
    if inside:
        name = a.get("id", "").lower()
        sure = name in _SURE_SECTIONS if node.tag == "section" else name in _SURE and node.tag not in _HEADINGS
        return sure or not _SURE.isdisjoint(a.get("class", "").lower().split())
    words = _words(_names(node))
    if words & _SKIP_WORDS:
        # An article element named after a section of the site is still an article.
        return not (node.tag == "article" and not words & {"comment", "comments", "reply", "related", "ad", "ads", "advert", "promo", "sponsored", "recommended"})
    return bool(words & _HEAD_WORDS) and not words & _CONTENT_WORDS


def blocks(node: Node, inside: bool, keep, out: list[str], relaxed: bool = False, body: tuple | None = None) -> None:
    """Texts of the blocks below a node in page order; keep(node, text) has the last word.

    body: a test and the keep of nodes that are inside of an article although their parents aren't.
    """
    run: list[str] = []

    def flush() -> None:
        if run:
            text = _SPACE.sub(" ", "".join(run)).strip()
            if text and keep(node, text):
                out.append(text)
            run.clear()

    for p in node.parts:
        if isinstance(p, str):
            run.append(p)
        else:
            flush()
            # Around an inner body a header may hold the heading.
            head = body and not skipped(p, True) and not _words(_names(p)) & _SKIP_WORDS
            if relaxed or head or not skipped(p, inside):
                if body and body[0](p):
                    blocks(p, True, body[1], out, relaxed)
                else:
                    blocks(p, inside, keep, out, relaxed, body)
    flush()


def _roots(node: Node, test, found: list[Node], relaxed: bool = False) -> list[Node]:
    """Outermost nodes that pass the test, outside of what is skipped."""
    for c in node.children:
        if not relaxed and skipped(c, False):
            continue
        if test(c):
            found.append(c)
        else:
            _roots(c, test, found, relaxed)
    return found


def _size(node: Node) -> int:
    out: list[str] = []
    blocks(node, True, lambda *_: True, out)
    return sum(map(len, out))


def _is_strong(node: Node) -> bool:
    return bool(node.attrs) and any(x.lower() in _STRONG for x in _names(node).split())


def content_roots(root: Node) -> tuple[list[Node], bool]:
    """The nodes that hold the article, if markup tells: all outermost ones; and whether what is around an inner article body is judged as outside of it."""
    tests = (
        _is_article,
        lambda n: n.tag == "main" or n.attrs.get("role") == "main",
        _is_strong,
        lambda n: bool(n.attrs) and n.tag in ("div", "section", "td") and bool(_words(_names(n)) & _CONTENT_WORDS),
    )
    for k, test in enumerate(tests):
        found = [n for n in _roots(root, test, []) if _size(n)]
        if found:
            # Main holds more than the article at times: lead and heading, but boxes too.
            return found, k == 1 and any(_size(n) for r in found for n in _roots(r, _is_strong, []))
    found = _roots(root, _is_article, [], True)  # an article inside of something left open
    return [n for n in found if _size(n)], False


# -- trees

#: label and children
Tree = tuple[str, tuple]


def _label(node: Node) -> str:
    # Names of the whole page and numbers in names tell pages apart, not slots.
    name = node.attrs.get("class") or node.attrs.get("id") or "" if node.attrs and node.tag not in ("html", "body") else ""
    return f"{node.tag}.{_DIGITS.sub('', name)}" if name else node.tag


def _folded(nodes: list[Node]) -> list[tuple[str, list[Node]]]:
    """The children of some nodes taken as one: runs of one label, in order."""
    out: list[tuple[str, list[Node]]] = []
    for node in nodes:
        runs: list[tuple[str, list[Node]]] = []
        for c in node.children:
            label = _label(c)
            if runs and runs[-1][0] == label:
                runs[-1][1].append(c)
            else:
                runs.append((label, [c]))
        if not out:
            out = runs
            continue
        have, new = [x[0] for x in out], [x[0] for x in runs]
        if have == new:
            pairs = [(i, i) for i in range(len(new))]
        elif len(have) * len(new) > WIDE:
            pairs = _by_label(have, new)
        else:
            match = SequenceMatcher(None, have, new, autojunk=False)
            pairs = [(m.a + i, m.b + i) for m in match.get_matching_blocks() for i in range(m.size)]
        out = _joined(out, runs, pairs, lambda x, y: (x[0], x[1] + y[1]))
    return out


def _by_label(xs: list[str], ys: list[str]) -> list[tuple[int, int]]:
    """The nth of each label with the nth."""
    places: dict[str, list[int]] = {}
    for i, x in enumerate(xs):
        places.setdefault(x, []).append(i)
    seen: dict[str, int] = {}
    out = []
    for j, y in enumerate(ys):
        n = seen[y] = seen.get(y, -1) + 1
        if n < len(places.get(y, ())):
            out.append((places[y][n], j))
    return out


def _joined(xs, ys, pairs: list[tuple[int, int]], both) -> list:
    """Both sequences in one, pairs as both(x, y); what has no partner between its neighbours, or at the end if pairs cross."""
    if any(p[0] >= q[0] for p, q in zip(pairs, pairs[1:])):
        to = dict(pairs)
        return [both(x, ys[to[i]]) if i in to else x for i, x in enumerate(xs)] + [y for j, y in enumerate(ys) if j not in {*to.values()}]
    out, i, j = [], 0, 0
    for x, y in pairs:
        out += [*xs[i:x], *ys[j:y], both(xs[x], ys[y])]
        i, j = x + 1, y + 1
    return [*out, *xs[i:], *ys[j:]]


def shape(root: Node) -> tuple[Tree, dict[int, int]]:
    """The folded tree of a page, and the preorder number there of each node, by the node's identity."""
    number: dict[int, int] = {}
    size = 0

    def build(label: str, nodes: list[Node]) -> Tree:
        nonlocal size
        for n in nodes:
            number[id(n)] = size
        size += 1
        return label, tuple([build(x, g) for x, g in _folded(nodes)])

    return build(root.tag, [root]), number


@lru_cache(maxsize=1 << 12)
def align(a: Tree, b: Tree) -> tuple[int, tuple]:
    """Simple tree matching: its weight, and (child of a, child of b, their match) for matched children.

    Equal subtrees at both ends are matched without a comparison of all pairs; beyond
    WIDE pairs siblings of one label are matched in order.
    """
    if a[0] != b[0]:
        return 0, ()
    xs, ys = a[1], b[1]
    lo, hi = 0, 0
    most = min(len(xs), len(ys))
    while lo < most and xs[lo] == ys[lo]:
        lo += 1
    while hi < most - lo and xs[-1 - hi] == ys[-1 - hi]:
        hi += 1
    n, m = len(xs) - lo - hi, len(ys) - lo - hi
    if n * m > WIDE:
        found = [(lo + i, lo + j) for i, j in _by_label([x[0] for x in xs[lo : lo + n]], [y[0] for y in ys[lo : lo + m]])]
    else:
        cells = [[align(x, y)[0] for y in ys[lo : lo + m]] for x in xs[lo : lo + n]]
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(1, n + 1):
            up, row, cell = best[i - 1], best[i], cells[i - 1]
            for j in range(1, m + 1):
                row[j] = max(up[j], row[j - 1], up[j - 1] + cell[j - 1])
        found, i, j = [], n, m
        while i and j:
            w = cells[i - 1][j - 1]
            if w and best[i][j] == best[i - 1][j - 1] + w:
                found.append((lo + i - 1, lo + j - 1))
                i, j = i - 1, j - 1
            elif best[i][j] == best[i - 1][j]:
                i -= 1
            else:
                j -= 1
        found.reverse()
    ends = [(i, i) for i in range(lo)], [(len(xs) - k, len(ys) - k) for k in range(hi, 0, -1)]
    weight, pairs = 1, []
    for i, j in (*ends[0], *found, *ends[1]):
        w, inner = align(xs[i], ys[j])
        weight += w
        pairs.append((i, j, inner))
    return weight, tuple(pairs)


def merge(a: Tree, b: Tree) -> Tree:
    """The wrapper of two trees with one root label."""
    if a == b:
        return a
    pairs = [(i, j) for i, j, _ in align(a, b)[1]]
    return a[0], tuple(_joined(a[1], b[1], pairs, merge))


def slots(wrapper: Tree, page: Tree) -> list[str | None]:
    """Slot (path in the wrapper) of each node of the page in preorder; None if it isn't aligned."""
    out: list[str | None] = []

    def walk(tree: Tree, at: str | None, pairs: tuple) -> None:
        out.append(at)
        to = {j: (i, inner) for i, j, inner in pairs}
        for j, c in enumerate(tree[1]):
            i, inner = to.get(j, (None, ()))
            walk(c, None if i is None or at is None else f"{at}{i}.", inner)

    walk(page, "", align(wrapper, page)[1])
    return out


def dump(tree: Tree) -> str:
    """Preorder, one line a node: depth, label."""
    lines: list[str] = []

    def walk(t: Tree, d: int) -> None:
        lines.append(f"{d} {_SPACE.sub(' ', t[0])}")
        for c in t[1]:
            walk(c, d + 1)

    walk(tree, 0)
    return "\n".join(lines)


@lru_cache(maxsize=256)
def load(source: str) -> Tree:
    """The tree of dump."""
    stack: list[tuple[str, list]] = []

    def fold(depth: int) -> None:
        while len(stack) > depth:
            label, kids = stack.pop()
            if not stack:
                stack.append((label, kids))
                return
            stack[-1][1].append((label, tuple(kids)))

    for line in source.split("\n"):
        d, _, label = line.partition(" ")
        if int(d):
            fold(int(d))
        stack.append((label, []))
    fold(1)
    label, kids = stack[0]
    return label, tuple(kids)


@lru_cache(maxsize=1 << 11)
def _slots_of(wrapper: str, page: str) -> list[str | None]:
    return slots(load(wrapper), load(page))


def slot_hash(slot: str, text: int) -> int:
    return xxhash.xxh3_64_intdigest(slot, seed=text) >> 1


def region(sizes: dict[str, int]) -> str | None:
    """The deepest slot that holds at least REGION_SHARE of all varying text; sizes: characters by slot."""
    total: dict[str, int] = {}
    for slot, n in sizes.items():
        parts = slot.split(".")[:-1]
        for k in range(len(parts) + 1):
            up = "".join(f"{p}." for p in parts[:k])
            total[up] = total.get(up, 0) + n
    least = REGION_SHARE * total.get("", 0)
    if not least:
        return None
    at = ""
    while True:
        depth = at.count(".")
        below = [s for s in total if s.startswith(at) and s.count(".") == depth + 1 and total[s] >= least]
        if not below or sizes.get(at, 0) > total[at] - least:
            return at
        at = max(below, key=lambda s: total[s])


# -- Spark


def host(url: str = "url") -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit(""))


def _text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text)


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page: hash of its main text, tree, and node, hash and unlinked characters (outside of landmarks) of each text."""
    kinds = {"host": pa.string(), "content": pa.int64(), "shape": pa.string(), "at": pa.list_(pa.int32()), "hashes": pa.list_(pa.int64()), "sizes": pa.list_(pa.int32())}
    for b in batches:
        cols: list[list] = [[] for _ in range(5)]
        for source in b.column(1).to_pylist():
            root = parse(source)
            tree, number = shape(root)
            found: dict[tuple[int, int], int] = {}
            inside: list[str] = []

            def note(node: Node, text: str) -> bool:
                found.setdefault((number[id(node)], _text_hash(text)), 0)
                return True

            def count(node: Node, text: str) -> bool:
                key = number[id(node)], _text_hash(text)
                found[key] = found.get(key, 0) + max(0, len(text) - node.link_chars)
                return True

            blocks(root, False, note, [], True)
            blocks(root, True, count, inside)
            keys = sorted(found)
            row = xxhash.xxh3_64_intdigest(main_text_of(root)) >> 1, dump(tree), [k[0] for k in keys], [k[1] - (1 << 64) if k[1] >> 63 else k[1] for k in keys], [found[k] for k in keys]
            for c, v in zip(cols, row):
                c.append(v)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, [*kinds.values()][1:]))], names=[*kinds])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partitions sorted by host and part: one wrapper of each, as trees stream by."""
    key, tree = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int32()), pa.array([dump(tree)])], names=["host", "part", "shape"])

    for b in batches:
        for h, part, source in zip(*(b.column(c).to_pylist() for c in ("host", "part", "shape"))):
            if key == (h, part):
                tree = merge(tree, load(source))
            else:
                if key is not None:
                    yield row()
                key, tree = (h, part), load(source)
    if key is not None:
        yield row()


def merged_trees(shapes: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """host, wrapper from host, shape: the same for any partitioning, as trees are merged in their order, bucket by bucket."""
    schema = "host string, part int, shape string"
    rows = shapes.select("host", "shape").distinct().withColumn("part", F.pmod(F.xxhash64("shape"), F.lit(buckets)).cast("int"))
    rows = rows.repartition("host", "part").sortWithinPartitions("host", "part", "shape").mapInArrow(_merged, schema)
    # At most `buckets` rows a host by now.
    rows = rows.withColumn("bucket", F.col("part")).withColumn("part", F.lit(0)).repartition("host").sortWithinPartitions("host", "bucket")
    return rows.mapInArrow(_merged, schema).select("host", F.col("shape").alias("wrapper"))


def _slotted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hosts, paths, keys, sizes = [], [], [], []
        for host_, source, wrapper, at, hashes, size in zip(*(b.column(c).to_pylist() for c in ("host", "shape", "wrapper", "at", "hashes", "sizes"))):
            to = _slots_of(wrapper, source)
            for i, h, n in zip(at, hashes, size):
                if to[i] is not None:
                    hosts.append(host_)
                    paths.append(to[i])
                    keys.append(slot_hash(to[i], h % (1 << 64)))
                    sizes.append(n)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64())], names=["host", "slot", "hash", "size"])


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [region({x["slot"]: x["size"] for x in items}) for items in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], names=["host", "region"])


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper, region, template array<struct<hash, share, pages>>: of hosts with enough different pages.

    pages: host, html.  Pages with the same main text (template included) are one page
    here, so that copies can't make an article template; pages without texts are none.
    """
    bones = pages.mapInArrow(_skeletons, "host string, content long, shape string, at array<int>, hashes array<long>, sizes array<int>").where(F.size("hashes") > 0)
    bones = durable(bones.groupBy("host", "content").agg(F.min(F.struct("shape", "at", "hashes", "sizes")).alias("b")).select("host", "content", "b.*"))
    enough = bones.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= MIN_PAGES)
    bones = bones.join(enough, "host")
    trees = durable(merged_trees(bones))
    texts = bones.join(trees, "host").select("host", "shape", "wrapper", "at", "hashes", "sizes").mapInArrow(_slotted, "host string, slot string, hash long, size long")
    texts = durable(texts.groupBy("host", "slot", "hash").agg(F.count("*").alias("n"), F.sum("size").alias("size")).join(enough, "host"))
    same = F.col("n") >= F.greatest(F.lit(MIN_PAGES * TEMPLATE_SHARE), TEMPLATE_SHARE * F.col("pages"))
    # At most 1 / TEMPLATE_SHARE times the texts of a page on average; sizes: as many as the wrapper has slots.
    template = texts.where(same).groupBy("host").agg(F.collect_set(F.struct("hash", (F.col("n") / F.col("pages")).alias("share"), "pages")).alias("template"))
    sizes = texts.where(~same & (F.col("size") > 0)).groupBy("host", "slot").agg(F.sum("size").alias("size"))
    sizes = sizes.groupBy("host").agg(F.collect_list(F.struct("slot", "size")).alias("sizes")).mapInArrow(_regions, "host string, region string")
    return trees.join(template, "host", "left").join(sizes, "host", "left")


@dataclass(frozen=True)
class Wrapper:
    """What is known of a host: merged tree, content region, template texts (hash: share, pages)."""

    tree: str
    region: str | None
    template: dict[int, tuple[float, int]]


def main_text(source: str | None, wrapper: Wrapper | None = None) -> str:
    """The main text of one page, given its host's wrapper."""
    return main_text_of(parse(source), wrapper)


def _holds(root: Node, wanted: set[int]) -> bool:
    """Whether a node of these identities is the root or below it."""
    stack = [root]
    while stack:
        node = stack.pop()
        if id(node) in wanted:
            return True
        stack += node.children
    return False


def _in_region(root: Node, slot: dict[int, str | None], region_: str) -> list[Node]:
    """Outermost nodes of the region, taken so wide that headings beside them are in."""
    found: list[Node] = []

    def walk(node: Node, up: list[Node]) -> None:
        for c in node.children:
            if slot.get(id(c)) == region_:
                top, path = c, [*up, node]
                # A heading next to the region belongs to it.
                while path and path[-1].tag not in ("body", "html", "#root") and any(x is not top and (x.tag in _HEADINGS or any(y.tag in _HEADINGS for y in x.children)) and not skipped(x, False) for x in path[-1].children):
                    top = path.pop()
                if not any(top is f for f in found):
                    found.append(top)
            else:
                walk(c, [*up, node])

    if region_ == "":
        return [root]
    walk(root, [])
    return [f for f in found if not any(f is not g and _holds(g, {id(f)}) for g in found)]


def decide(root: Node, wrapper: Wrapper | None) -> tuple[str, str]:
    """The main text of a parsed page and what told it: 'region', 'markup' (agreeing with the region), 'alone' (nothing learnt), 'none'."""
    slot: dict[int, str | None] = {}
    template = wrapper.template if wrapper else {}
    if wrapper:
        tree, number = shape(root)
        to = _slots_of(wrapper.tree, dump(tree))
        slot = {i: to[n] for i, n in number.items()}

    def varies(share: float, pages: int):
        def keep(node: Node, text: str) -> bool:
            at = slot.get(id(node)) if template else None
            t = None if at is None else template.get(slot_hash(at, _text_hash(text)))
            return t is None or t[0] < share or t[1] < pages

        return keep

    article, keep = varies(ARTICLE_SHARE, ARTICLE_PAGES), varies(TEMPLATE_SHARE, MIN_PAGES)
    page = lambda n, t: keep(n, t) and n.link_chars <= 0.5 * len(t)

    def marked(roots: list[Node], around: bool) -> list[str]:
        out: list[str] = []
        for r in roots:
            if around:
                blocks(r, False, page, out, body=(_is_strong, article))
            else:
                blocks(r, True, article, out)
        return out

    roots, around = content_roots(root)
    told = "alone"
    if wrapper and wrapper.region is not None and (inside := _in_region(root, slot, wrapper.region)):
        agree = [r for r in roots if any(_holds(r, {id(x) for x in inside}) or _holds(x, {id(r)}) for x in inside)]
        if agree:
            # Parts of one article may lie beside the region: those of the same kind stay.
            told = "markup"
        else:
            out = []
            for r in inside:
                blocks(r, False, page, out)
            if out:
                return " ".join(out), "region"
    out = marked(roots, around)
    if out or roots:
        return " ".join(out), told
    blocks(root, False, page, out)
    return " ".join(out), told if out else "none"


def main_text_of(root: Node, wrapper: Wrapper | None = None) -> str:
    """The main text of a parsed page."""
    return decide(root, wrapper)[0]


_OUT = "page_id long, url string, text string, n_chars long, told_by string"


def _answers(b: pa.RecordBatch, known: list[Wrapper | None]) -> pa.RecordBatch:
    found = [decide(parse(s), w) for s, w in zip(b.column(3).to_pylist(), known)]
    texts = [t for t, _ in found]
    return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([w for _, w in found], pa.string())], names=["page_id", "url", "text", "n_chars", "told_by"])


def extract(pages: DataFrame, share_bytes: int = SHARE_BYTES) -> DataFrame:
    """page_id, url, text, n_chars, told_by (of decide) of every page."""
    lean(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host().alias("host"), "html")
    found = durable(wrappers(rows.select("host", "html")))
    size = found.agg(F.sum(F.length("host") + F.length("wrapper") + 24 * F.coalesce(F.size("template"), F.lit(0)) + 64).alias("n")).first()["n"] or 0
    known = lambda wrapper, region_, items: Wrapper(wrapper, region_, {x["hash"]: (x["share"], x["pages"]) for x in items or ()})
    if size <= share_bytes:
        shared = pages.sparkSession.sparkContext.broadcast({r["host"]: known(r["wrapper"], r["region"], r["template"]) for r in found.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield _answers(b, [shared.value.get(h) for h in b.column(2).to_pylist()])

        return rows.mapInArrow(run, _OUT)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _answers(b, [None if w is None else known(w, r, t) for w, r, t in zip(*(b.column(c).to_pylist() for c in (4, 5, 6)))])

    return rows.join(found, "host", "left").select("page_id", "url", "host", "html", "wrapper", "region", "template").mapInArrow(joined, _OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
