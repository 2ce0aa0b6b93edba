"""SimHash near-duplicates found with the May-Ozerov recursion.

A document's features are its distinct pairs of neighbouring words (its words,
if fewer than two); each votes on `BITS` bits.  Texts without words get the hash
of the text itself.  Documents are near duplicates if their fingerprints differ
in at most `MAX_DISTANCE` bits; classes are the connected components.

Search for all close pairs of distinct fingerprints, after May and Ozerov: a
repetition draws disjoint strips of random coordinates, one for each level, and
random centres on each strip.  A fingerprint stays in the list of a centre if
its partial weight relative to the centre is at most the radius there; lists are
filtered again on the next strip, and so on.  Each list is then searched by brute
force.  Repetitions go on until a pair at the largest distance is missed with
probability below 1 - `RECALL`; the number comes from the exact probability that a
repetition finds it.  Width of a strip, radius, centres and levels are those of
least cost for the number of fingerprints, by a model of rows sent, comparisons
and tests of centres (`plan`): lists stay short at any size, and rows sent grow slowly.

A list only sends one edge a member, to its component's least node there; a dense
cluster is absorbed breadth first, without comparing its members among each other.
Links are counted afterwards, inside the components, so a pair that meets in many
lists counts once.  A list or component expected to be longer than `BLOCK` is cut into blocks, and
pairs of blocks are compared in separate tasks: nothing is dropped.

Distinct fingerprints are numbered, so no hash stands for a fingerprint.

Defined cases: a null text takes no part (own class, no links); equal texts,
empty ones included, share a class; a very long text is one row like any other,
its features taken piece by piece; repeated doc_ids are rows of their own with
the class of their text; ties between vote counts are settled by the least
feature's hash; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .graph import components
from .session import durable, lean

BITS = 256
MAX_DISTANCE = 64
RECALL = 0.995
BLOCK = 32_768
#: One fingerprint in so many is looked at to see which lists are longer than BLOCK.
SAMPLE = 16
#: Seconds to send a row (its bytes on disk and network weighed in), compare a pair, test a centre, and take a strip: the cost model of plan.
ROW_S, PAIR_S, CENTRE_S, STRIP_S = 1.6e-5, 4.5e-9, 0.7e-9, 0.6e-6
#: Rows a fingerprint that one round of repetitions sends at most.
SENT = 64.0
#: Column of row numbers in deduplicate.
_ROW = "row_number_"
_FP = [f"f{i}" for i in range(4)]
_SALTS = [np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)]


def _votes(feature: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints (n, 4) from sorted-by-row distinct feature hashes."""
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    size = np.diff(np.concatenate((first, [len(row)])))
    # Blocks of at most 255 features inside a row: their bit counts fit a byte.
    per = (size + 254) // 255
    block = K.ranges(np.zeros(len(first), np.int64), per) * 255 + np.repeat(first, per)
    out = np.zeros((n, 4), np.uint64)
    owner = np.concatenate(([0], np.cumsum(per)[:-1]))
    least = np.minimum.reduceat(feature, first)
    for w in range(4):
        bits = np.unpackbits(K.mix(feature ^ _SALTS[w]).view(np.uint8).reshape(-1, 8), axis=1).view(np.uint64)
        counts = np.add.reduceat(bits, block, axis=0).view(np.uint8).astype(np.int32)
        votes = 2 * np.add.reduceat(counts, owner, axis=0) - size[:, None]
        tie = np.unpackbits(K.mix(least ^ _SALTS[w]).view(np.uint8).reshape(-1, 8), axis=1)
        out[row[first], w] = np.packbits((votes > 0) | ((votes == 0) & (tie > 0)), axis=1).view(np.uint64).ravel()
    return out


def fingerprints(texts: pa.Array) -> np.ndarray:
    """(n, 4) uint64 of a string array."""
    off, raw = K.string_parts(texts)
    out = np.zeros((len(off) - 1, 4), np.uint64)
    for i, j in K.slices(off):
        buf, at = K.joined(off, raw, i, j)
        _, _, h, row = K.words(buf, at, K.ALNUM, lower=True)
        n_words = np.bincount(row, minlength=j - i)
        with np.errstate(over="ignore"):
            pair = K.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
        same = row[1:] == row[:-1]
        alone = n_words[row] == 1
        feature = np.concatenate((pair[same], h[alone]))
        frow = np.concatenate((row[1:][same], row[alone]))
        if len(feature):
            order = np.lexsort((feature, frow))
            feature, frow = feature[order], frow[order]
            new = np.concatenate(([True], (feature[1:] != feature[:-1]) | (frow[1:] != frow[:-1])))
            out[i:j] = _votes(feature[new], frow[new], j - i)
        for k in np.flatnonzero(n_words == 0):
            text = raw[off[i + k] : off[i + k + 1]].tobytes()
            out[i + k] = [xxhash.xxh3_64_intdigest(text, seed=s) for s in range(4)]
    return out


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = fingerprints(b.column(1)).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(fp[:, w])) for w in range(4))], names=["doc_id", *_FP])


# -- May-Ozerov


@dataclass(frozen=True)
class Plan:
    """Strip width, radius, centres of a level, levels, and repetitions."""

    strip: int
    radius: int
    centres: int
    levels: int
    reps: int

    @property
    def stay(self) -> float:
        """Share of random fingerprints that stay in the list of a centre."""
        return sum(math.comb(self.strip, i) for i in range(self.radius + 1)) / 2**self.strip

    @property
    def sent(self) -> float:
        """Rows a fingerprint that one repetition sends, on average."""
        return (self.centres * self.stay) ** self.levels


@lru_cache(maxsize=None)
def found_once(distance: int, strip: int, radius: int, centres: int, levels: int) -> float:
    """Probability that one repetition puts a pair at this distance into a common list.

    A level finds the pair if any of its centres is near both; that depends on the
    differing bits in its strip, so it is averaged over their number, strip by strip,
    as strips share no coordinate.
    """
    share, bits = {distance: 1.0}, BITS
    level = []
    for s in range(strip + 1):
        both = sum(math.comb(s, i) * math.comb(strip - s, j) for i in range(s + 1) for j in range(strip - s + 1) if i + j <= radius and s - i + j <= radius)
        level.append(1 - (1 - both / 2**strip) ** centres)
    for _ in range(levels):
        left: dict[int, float] = {}
        for d, weight in share.items():
            for s in range(max(0, strip - bits + d), min(strip, d) + 1):
                drawn = math.comb(d, s) * math.comb(bits - d, strip - s) / math.comb(bits, strip)
                left[d - s] = left.get(d - s, 0.0) + weight * drawn * level[s]
        share, bits = left, bits - strip
    return sum(share.values())


def repetitions(found: float, recall: float = RECALL) -> int:
    """Repetitions after which a pair that one of them finds with this probability is missed with probability at most 1 - recall."""
    return max(1, math.ceil(math.log(1 - recall) / math.log1p(-found)))


def cost(p: Plan, n: int) -> float:
    """Seconds of work a fingerprint, of n."""
    return p.reps * (p.sent * (ROW_S + PAIR_S * n * p.stay**p.levels) + p.levels * (STRIP_S + CENTRE_S * p.centres))


#: Strip widths, radii, centres and levels that plan looks through.
_GRID = [(s, r, c, t) for s, most in ((16, 3), (18, 3), (20, 4), (22, 5), (24, 6)) for r in range(2, most + 1) for c in (256, 512, 1024, 2048, 4096) for t in (1, 2, 3)]


@lru_cache(maxsize=64)
def plan(n: int, recall: float = RECALL) -> Plan:
    """The cheapest parameters for n distinct fingerprints that reach the recall at MAX_DISTANCE, with lists that fit a block."""
    best = None
    for s, r, c, t in _GRID:
        found = found_once(MAX_DISTANCE, s, r, c, t)
        if found < 1e-5:
            continue
        p = Plan(s, r, c, t, repetitions(found, recall))
        if n * p.stay**t <= BLOCK and (best is None or cost(p, n) < cost(best, n)):
            best = p
    return best or Plan(24, 5, 512, 3, repetitions(found_once(MAX_DISTANCE, 24, 5, 512, 3), recall))


class Filters:
    """Strips and centres of all repetitions."""

    def __init__(self, p: Plan, seed: int = 7):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.plan = p
        self.coords = np.stack([rng.permutation(BITS)[: p.levels * p.strip].reshape(p.levels, p.strip) for _ in range(p.reps)])
        self.points = rng.integers(0, 1 << p.strip, size=(p.reps, p.levels, p.centres), dtype=np.uint32)

    def near(self, bits: np.ndarray, r: int, t: int) -> np.ndarray:
        """(n, centres) booleans: partial weight at most the radius; bits: (n, BITS) of 0 and 1."""
        weight = (1 << np.arange(self.plan.strip)).astype(np.float32)  # exact below 2**24
        strip = (bits[:, self.coords[r, t]].astype(np.float32) @ weight).astype(np.uint32)
        return np.bitwise_count(strip[:, None] ^ self.points[r, t][None, :]) <= self.plan.radius

    def lists(self, fp: np.ndarray, first: int, last: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Repetition, members and list number (below centres ** levels) of repetitions first to last - 1."""
        bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(len(fp), -1), axis=1)
        for r in range(first, last):
            who, name = np.nonzero(self.near(bits, r, 0))
            for t in range(1, self.plan.levels):
                row, centre = np.nonzero(self.near(bits, r, t))
                lo = np.searchsorted(row, who)
                count = np.searchsorted(row, who, "right") - lo
                name = np.repeat(name * self.plan.centres, count) + centre[K.ranges(lo, count)]
                who = np.repeat(who, count)
            yield r, who, name


#: Cells of a distance matrix held at once, and pairs kept before they are folded into roots.
_CELLS, _PAIRS = 1 << 17, 1 << 20


def _near(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of fingerprints (columns of words) within MAX_DISTANCE."""
    d = np.bitwise_count(a[0][:, None] ^ b[0][None])
    for w in (1, 2):
        d += np.bitwise_count(a[w][:, None] ^ b[w][None])
    x, y = np.nonzero(d <= MAX_DISTANCE)  # three words of four already tell nearly all pairs apart
    good = d[x, y] + np.bitwise_count(a[3][x] ^ b[3][y]) <= MAX_DISTANCE
    return x[good], y[good]


def _fold(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Roots (least index of each component) after the links x, y are added."""
    while True:
        a, b = root[x], root[y]
        low = np.minimum(a, b)
        if (a == b).all():
            return root
        root = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while not (root[root] == root).all():
            root = root[root]


def _roots(fp: np.ndarray, side: np.ndarray | None = None) -> np.ndarray:
    """Least index of each row's component; side: only links between rows of different sides are looked for.

    Rows are compared in blocks with all later ones.  Where a row is near to many, its
    component is taken in breadth first and leaves as a whole.
    """
    cols = [np.ascontiguousarray(fp[:, w]) for w in range(4)]
    take = lambda at: [c[at] for c in cols]
    root, xs, ys, held = np.arange(len(fp)), [], [], 0

    def add(x: np.ndarray, y: np.ndarray) -> None:
        nonlocal root, held
        xs.append(x)
        ys.append(y)
        held += len(x)
        if held > _PAIRS:
            root = _fold(root, np.concatenate(xs), np.concatenate(ys))
            xs.clear()
            ys.clear()
            held = 0

    def across(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = max(1, _CELLS // max(1, len(b)))
        for i in range(0, len(a), step):
            x, y = _near(take(a[i : i + step]), take(b))
            yield a[i : i + step][x], b[y]

    if side is not None:
        one, two = np.flatnonzero(side == side.min()), np.flatnonzero(side != side.min())
        for x, y in across(one, two):
            add(x, y)
    else:
        left = np.arange(len(fp))
        while len(left) > 1:
            step = max(1, _CELLS // len(left))
            x, y = _near(take(left[:step]), take(left))
            each = np.bincount(x, minlength=1)
            if (most := int(each.max(initial=0))) > 256 and 8 * most > len(left):
                near = np.zeros(len(left), bool)
                near[y[x == each.argmax()]] = True
                inside, rest = left[near], left[~near]
                front = [inside]
                while len(front[-1]) and len(rest):
                    hit = np.zeros(len(fp), bool)
                    for _, y in across(front[-1], rest):
                        hit[y] = True
                    front.append(rest[hit[rest]])
                    rest = rest[~hit[rest]]
                every = np.concatenate(front)
                add(np.full(len(every), every[0]), every)
                left = rest
            else:
                later = y > x
                add(left[x[later]], left[y[later]])
                left = left[step:]
    return _fold(root, np.concatenate(xs), np.concatenate(ys)) if xs else root


def _prints(table: pa.Table) -> np.ndarray:
    return np.stack([table[c].to_numpy() for c in _FP], axis=1).view(np.uint64)


def _search(key: tuple, table: pa.Table) -> pa.Table:
    """One list or pair of blocks: u, v (its component's least node there) of linked nodes."""
    table = table.sort_by("node")
    node = table["node"].to_numpy()
    root = _roots(_prints(table), None if key[1].as_py() == key[2].as_py() else table["block"].to_numpy())
    linked = np.flatnonzero(root != np.arange(len(root)))
    return pa.table([pa.array(node[linked]), pa.array(node[root[linked]])], names=["u", "v"])


def _count(key: tuple, table: pa.Table) -> pa.Table:
    """One component or pair of blocks of one: node, links."""
    fp, node, block = _prints(table), table["node"].to_numpy(), table["block"].to_numpy()
    across = key[1].as_py() != key[2].as_py()
    one = np.flatnonzero(block == block.min()) if across else np.arange(len(fp))
    two = np.flatnonzero(block != block.min()) if across else one
    links = np.zeros(len(fp), np.int64)
    other = [np.ascontiguousarray(fp[two, w]) for w in range(4)]
    step = max(1, _CELLS // max(1, len(two)))
    for i in range(0, len(one), step):
        x, y = _near([np.ascontiguousarray(fp[one[i : i + step], w]) for w in range(4)], other)
        links += np.bincount(one[i : i + step][x], minlength=len(fp))
        if across:
            links += np.bincount(two[y], minlength=len(fp))
    return pa.table([pa.array(node), pa.array(links if across else links - 1)], names=["node", "links"])


def _members(filters, first: int, last: int):
    names = ["key", "node", *_FP]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = filters.value
        total = f.plan.centres**f.plan.levels
        for b in batches:
            node = b.column(0).to_numpy()
            fp = np.stack([b.column(i).to_numpy() for i in range(1, 5)], axis=1)
            for i in range(0, len(fp), 1024):
                part = fp[i : i + 1024]
                for r, who, name in f.lists(part, first, last):
                    yield pa.RecordBatch.from_arrays([pa.array(r * total + name), pa.array(node[i + who]), *(pa.array(part[who, w]) for w in range(4))], names=names)

    return run


def _cut(members: DataFrame, sizes: DataFrame, key: str, block: int) -> DataFrame:
    """members with block, i, j: those of keys in sizes (key, size) in pairs of blocks of about `block` rows, others whole."""
    plain = members.select("*", *(F.lit(0).alias(c) for c in ("block", "i", "j")))
    if sizes.isEmpty():
        return plain
    cols = members.columns
    cut = members.join(sizes, key).withColumn("m", F.ceil(F.col("size") / block).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
    cut = cut.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    cut = cut.select(*cols, "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    return plain.join(sizes, key, "left_anti").unionByName(cut)


_MEMBERS = "key long, node long, f0 long, f1 long, f2 long, f3 long"


def edges(nodes: DataFrame, recall: float = RECALL, block: int = BLOCK, sent: float = SENT, sample: int = SAMPLE, parameters: Plan | None = None) -> DataFrame:
    """u, v: links that connect every component, from distinct fingerprints node, f0..f3.

    Repetitions go in rounds that send at most about `sent` rows a fingerprint, each
    round's result being kept, so that what is on disk at once doesn't grow with the
    number of repetitions.  Which lists are cut is told by every `sample`-th node;
    cutting one more or less changes no result.
    """
    p = parameters or plan(nodes.count(), recall)
    filters = nodes.sparkSession.sparkContext.broadcast(Filters(p))
    nodes = nodes.select("node", *_FP)
    some = nodes.where(F.pmod(F.xxhash64("node"), F.lit(sample)) == 0)
    step = -(-p.reps // math.ceil(p.reps * p.sent / sent))
    parts = []
    for r in range(0, p.reps, step):
        one = _members(filters, r, min(r + step, p.reps))
        sizes = durable(some.mapInArrow(one, _MEMBERS).groupBy("key").agg((F.count("*") * sample).alias("size")).where(F.col("size") > block))
        found = _cut(nodes.mapInArrow(one, _MEMBERS), sizes, "key", block).groupBy("key", "i", "j").applyInArrow(_search, "u long, v long")
        parts.append(durable(found.distinct()))
    return reduce(DataFrame.unionByName, parts)


def count_links(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """node, n_links: other nodes of the component (root) within MAX_DISTANCE; nodes: node, root, f0..f3."""
    sizes = durable(nodes.groupBy("root").agg(F.count("*").alias("size")).where(F.col("size") > block))
    by = ["root", "i", "j"]
    # So many partitions in any case: the rows are few, the pairs among them many.
    members = _cut(nodes.select("root", "node", *_FP), sizes, "root", block).repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
    found = members.groupBy(*by).applyInArrow(_count, "node long, links long")
    return found.groupBy("node").agg(F.sum("links").alias("n_links"))


def near_duplicates(docs: DataFrame, recall: float = RECALL, block: int = BLOCK, sent: float = SENT, sample: int = SAMPLE, parameters: Plan | None = None) -> DataFrame:
    """doc_id, class_id (least doc_id of the class), n_links (other fingerprints within MAX_DISTANCE), n_copies (rows with this fingerprint)."""
    lean(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    prints = durable(docs.where(F.col("text").isNotNull()).mapInArrow(_fingerprint, "doc_id long, f0 long, f1 long, f2 long, f3 long"))
    nodes = prints.groupBy(*_FP).agg(F.min("doc_id").alias("least"), F.count("*").alias("n_copies"))
    nodes = durable(nodes.withColumn("node", F.monotonically_increasing_id()))
    roots = components(edges(nodes, recall, block, sent, sample, parameters))
    classes = durable(nodes.join(roots, "node"))
    n_links = count_links(classes, max(2, block // 4))
    least = classes.groupBy("root").agg(F.min("least").alias("class_id"))
    linked = classes.select("node", "root").join(least, "root").join(n_links, "node").select("node", "class_id", "n_links")
    node = nodes.join(linked, "node", "left").select(*_FP, F.coalesce("class_id", "least").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "n_copies")
    rows = prints.join(node, _FP).select("doc_id", "class_id", "n_links", "n_copies")
    null = docs.where(F.col("text").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return rows.unionByName(null)


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each class stays, the one with the least doc_id; a doc_id that is in several classes or null only if the class has no other.

    Rows are told apart by a number of their own, so a repeated or null doc_id with
    different texts is judged text by text, and its rows stay or go one by one.  Null
    texts are in no class and stay; of those that repeat a doc_id, one.
    """
    rows = durable(docs.withColumn(_ROW, F.monotonically_increasing_id()))
    found = near_duplicates(rows.select(F.col(_ROW).alias("doc_id"), "text"))
    found = found.select(F.col("doc_id").alias(_ROW), "class_id", (F.expr("n_links > 0 OR n_copies > 1")).alias("more"))
    found = durable(found.join(rows.select(_ROW, F.col("doc_id").cast("long").alias("doc_id")), _ROW))
    many = found.groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("b")).where("a < b AND doc_id IS NOT NULL").select("doc_id", F.lit(True).alias("several"))
    ranked = found.where("more").join(many, "doc_id", "left")
    ranked = ranked.select(_ROW, "class_id", F.struct(F.col("doc_id").isNull().alias("none"), F.col("several").isNotNull().alias("several"), "doc_id", _ROW).alias("rank"))
    first = ranked.groupBy("class_id").agg(F.min("rank").alias("first"))
    gone = ranked.join(first, "class_id").where(F.col(_ROW) != F.col("first").getField(_ROW)).select(_ROW)
    empty = rows.where("text IS NULL AND doc_id IS NOT NULL").select("doc_id", _ROW)
    again = empty.join(empty.groupBy("doc_id").agg(F.min(_ROW).alias("least")), "doc_id").where(F.col(_ROW) != F.col("least")).select(_ROW)
    return rows.join(gone.unionByName(again), _ROW, "left_anti").select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "class_id", "n_links", "n_copies", (F.col("doc_id") == F.col("class_id")).alias("kept"))
