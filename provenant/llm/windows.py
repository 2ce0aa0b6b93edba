"""Repeated windows of tokens: super-k-mers, buckets, and exact counting in them.

Every window of `length` consecutive tokens of a document has a minimiser: the
k-token gram of least hash in it (the leftmost such).  Consecutive windows with
one minimiser form a super-k-mer, a run of tokens that travels as one.  Equal
windows have equal minimisers, so:

1. super-k-mers are described by (minimiser, two hashes of the run, document,
   first token, number of windows): about 40 bytes for `(length - k) / 2` tokens;
2. minimisers that occur once are dropped: a pre-aggregated count, then a join;
3. runs that are equal as a whole are merged (pre-aggregated); one of each
   distinct run goes, packed, to the bucket of its minimiser if the bucket
   has more than one distinct run; there the windows are sorted and counted;
4. buckets of more than `hot` distinct runs are cut into single windows, counted
   by a pre-aggregated grouping on two hashes instead: no bucket grows unbounded
   in one task, and nothing is dropped.

The two users differ in their tokens (bytes or words), in the rule that marks a
window (it occurs twice; or it occurs in an earlier document), and in how runs
are sorted inside a bucket.  Documents are numbered by doc_id, rows of a
repeated or null doc_id by `numbered`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .session import durable, lean

#: Distinct runs in a bucket beyond which its windows are counted one by one.
HOT = 4096
#: Low bits of a key that hold the position, the others order grams.
_POS = np.uint64((1 << 26) - 1)


@dataclass(frozen=True)
class Spec:
    """length and k in tokens; tokens: 'bytes' or 'words'; earlier: mark windows of earlier documents instead of all repeats.

    placed: documents have a column place that orders them, as rows of one doc_id aren't earlier than each other (numbered); else doc does.
    """

    length: int
    k: int
    tokens: str
    earlier: bool
    placed: bool = False
    #: How the windows of a bucket are ordered: tokens, starts, buckets, length to classes; None: sort_windows.
    order: Callable | None = None

    @property
    def place(self) -> str:
        return "place" if self.placed else "doc"


def token_values(spec: Spec, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens (bytes as such, words as two hashes, (2, n)) and the row of each, of joined rows (the separators left out)."""
    if spec.tokens == "words":
        _, _, h, row = K.words(buf, at, K.NOT_SPACE, two=True)
        return h, row
    row = np.zeros(len(buf), np.int32)
    row[at[1:]] = 1
    row = np.cumsum(row, dtype=np.int32)
    keep = np.ones(len(buf), bool)
    keep[np.concatenate((at[1:], [len(buf)])) - 1] = False
    return buf[keep], row[keep]


def hashed(tokens: np.ndarray, which: int) -> np.ndarray:
    """Tokens as 64-bit values, in two unrelated ways; bytes get theirs piece by piece, as they take eight times the room then."""
    return K.TABLES[which].take(tokens) if tokens.dtype == np.uint8 else tokens[which]


def super_kmers(spec: Spec, values: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
    """First token, number of windows, minimiser, two hashes of the run, of all super-k-mers, for tokens in one piece."""
    L, k = spec.length, spec.k
    n = values.shape[-1] - L + 1
    if n <= 0:
        z = np.empty(0, np.int64)
        return z, z, z.astype(np.uint64), z.astype(np.uint64), z.astype(np.uint64)
    pre = K.prefix(hashed(values, 0), 0)
    grams = K.window_hash(pre, k, 0)
    pos = np.arange(len(grams), dtype=np.uint64)
    least = K.sliding_min((grams & ~_POS) | pos, L - k + 1) & _POS
    good = row[:n] == row[L - 1 :]
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | ~good[:-1] | (row[1:n] != row[: n - 1])
    first = np.flatnonzero(new & good)
    stop = np.flatnonzero(np.concatenate((new[1:] | ~good[1:], [True])) & good) + 1
    count = stop - first
    end = first + count + L - 1
    other = K.prefix(hashed(values, 1), 1)
    return first, count, grams[least[first].astype(np.int64)], K.run_hash(pre, first, end, 0), K.run_hash(other, first, end, 1)


#: Tokens handled at once; longer pieces overlap by a window.
_PIECE = 1 << 21


def _pieces(spec: Spec, values: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    step = _PIECE - spec.length + 1
    for lo in range(0, max(len(row) - spec.length + 1, 1), step):
        yield lo, super_kmers(spec, values[..., lo : lo + _PIECE], row[lo : lo + _PIECE])


def _describe(spec: Spec) -> Callable:
    names = ["mkey", "h1", "h2", "doc", "start", "n", *(["place"] if spec.placed else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            more = [b.column(2).to_numpy(zero_copy_only=False)] if spec.placed else []
            off, raw = K.string_parts(b.column(1))
            for i, j in K.slices(off):
                values, row = token_values(spec, *K.joined(off, raw, i, j))
                begin = np.searchsorted(row, np.arange(j - i))
                for lo, (first, count, key, h1, h2) in _pieces(spec, values, row):
                    r = row[first + lo]
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(ids[i:j][r]), pa.array((first + lo - begin[r]).astype(np.int32)), pa.array(count.astype(np.int32)), *(pa.array(m[i:j][r]) for m in more)], names=names)

    return run


def describe(spec: Spec, docs: DataFrame) -> DataFrame:
    return docs.mapInArrow(_describe(spec), "mkey long, h1 long, h2 long, doc long, start int, n int" + (", place long" if spec.placed else ""))


# -- packed runs


def _pack(spec: Spec) -> Callable:
    """Rows doc, text, wanted (array of structs start, n, ...) to one row a wanted run, with its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off, raw = K.string_parts(b.column(1))
            lists = b.column(2)
            lo = lists.offsets.to_numpy()
            flat = lists.values
            cols = {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}
            picked, data = [], []
            for r in range(b.num_rows):
                text = raw[off[r] : off[r + 1]]
                wanted = np.arange(lo[r], lo[r + 1])
                s, e = cols["start"][wanted], cols["start"][wanted] + cols["n"][wanted] + spec.length - 1
                if spec.tokens == "bytes":
                    data += [text[x:y].tobytes() for x, y in zip(s, e)]
                else:
                    ws, we = K.word_spans(np.concatenate((text, [np.uint8(32)])), K.NOT_SPACE)
                    for x, y in zip(s, e):
                        part = text[ws[x] : we[y - 1]].tobytes()
                        data.append(b" ".join(part.split()))
                picked.append(wanted)
                if len(data) >= 4096 or r == b.num_rows - 1:
                    at = np.concatenate(picked)
                    yield pa.RecordBatch.from_arrays([*(pa.array(cols[c][at]) for c in ("mkey", "h1", "h2", "low", "many", "n")), pa.array(cols["hot"][at]), pa.array(data, pa.binary())], names=["mkey", "h1", "h2", "low", "many", "n", "hot", "packed"])
                    picked, data = [], []

    return run


def _tokens_of(spec: Spec, packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Integer tokens of packed runs, equal if and only if the tokens are; and where each run starts."""
    if spec.tokens == "bytes":
        return np.frombuffer(b"".join(packed), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in packed])))
    words = [p.split(b" ") for p in packed]
    number: dict[bytes, int] = {}
    flat = np.fromiter((number.setdefault(w, len(number)) for ws in words for w in ws), np.int64)
    return flat, np.concatenate(([0], np.cumsum([len(w) for w in words])))


def _packed_digits(spec: Spec, tokens: np.ndarray) -> tuple[np.ndarray, int]:
    """The digit that starts at each token, and its tokens: eight bytes, or as many word numbers as fit 62 bits."""
    if spec.tokens == "bytes":
        width, bits = min(8, spec.length), np.uint64(8)
    else:
        size = max(1, int(tokens.max(initial=1)).bit_length())
        width, bits = min(max(1, 62 // size), spec.length), np.uint64(size)
    padded = np.concatenate((tokens.astype(np.uint64), np.zeros(width, np.uint64)))
    code = np.zeros(len(tokens), np.uint64)
    for b in range(width):
        code = (code << bits) | padded[b : b + len(tokens)]
    return code, width


def _places(length: int, width: int) -> list[int]:
    """Where the digits of a window start; the last may overlap the one before."""
    out = [*range(0, length - width + 1, width)]
    return out if out[-1] + width >= length else [*out, length - width]


def _refine(group: np.ndarray, digit: np.ndarray) -> np.ndarray:
    """Classes by group and digit, in order of both."""
    order = np.lexsort((digit, group))
    g, d = group[order], digit[order]
    new = np.concatenate(([True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])))
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def sort_windows(spec: Spec, tokens: np.ndarray, start: np.ndarray, bucket: np.ndarray, hashed: bool = True) -> np.ndarray:
    """Class of each window (of spec.length tokens at `start`): -1 if no other window of its bucket equals it.

    Most-significant-digit passes, as deep as the window: the bucket is the first
    digit; after each pass windows that are alone in their class leave.  The further
    digits are the two halves of a window, by 64 hash bits; what is still together is
    then compared by packed tokens.  Were two halves to share a hash, all passes would
    be done again with digits of packed tokens.
    """
    alive, out = np.arange(len(start)), np.full(len(start), -1, np.int64)
    if not len(start):
        return out
    code, width = _packed_digits(spec, tokens)
    digits, places = code, _places(spec.length, width)
    if hashed:
        half = (spec.length + 1) // 2
        values = K.TABLES[0].take(tokens) if spec.tokens == "bytes" else K.mix(tokens.astype(np.uint64) + np.uint64(1))
        digits, places = K.window_hash(K.prefix(values, 0), half, 0), [0, spec.length - half]
    group = np.unique(bucket, return_inverse=True)[1]
    for d in [None, *places]:
        if d is not None:
            group = _refine(group, digits[start[alive] + d])
        stay = np.bincount(group)[group] > 1
        alive, group = alive[stay], group[stay]
        if not len(alive):
            return out
    if hashed:
        order = np.argsort(group, kind="stable")
        same = np.flatnonzero(group[order][1:] == group[order][:-1])
        x, y = start[alive[order]][same], start[alive[order]][same + 1]
        if any((code[x + d] != code[y + d]).any() for d in _places(spec.length, width)):
            return sort_windows(spec, tokens, start, bucket, False)
    out[alive] = group
    return out


def _bucket_result(spec: Spec, cols: dict[str, np.ndarray], packed: list[bytes]) -> pa.RecordBatch:
    """Runs of marked windows, for all distinct packed runs of some whole buckets."""
    tokens, at = _tokens_of(spec, packed)
    n = cols["n"].astype(np.int64)
    owner = np.repeat(np.arange(len(n)), n)
    inner = K.ranges(np.zeros(len(n), np.int64), n)
    start, bucket = at[:-1][owner] + inner, cols["mkey"][owner]
    cls = spec.order(tokens, start, bucket, spec.length) if spec.order else sort_windows(spec, tokens, start, bucket)
    if spec.earlier:
        low = cols["low"][owner]
        least = np.full(int(cls.max(initial=-1)) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, cls[cls >= 0], low[cls >= 0])
        mark = (cls >= 0) & (least[cls] < low) if len(least) else np.zeros(len(cls), bool)
    else:
        mark = cls >= 0
    s, e = K.runs(mark)
    # A run of marks must not cross from one packed run into the next.
    edges = np.concatenate(([0], np.cumsum(n)))
    cut = edges[(edges > 0) & (edges < len(mark))]
    cut = cut[mark[cut - 1] & mark[cut]] if len(mark) else cut
    s, e = np.sort(np.concatenate((s, cut))), np.sort(np.concatenate((e, cut)))
    o = owner[s] if len(s) else s
    return pa.RecordBatch.from_arrays([pa.array(cols["h1"][o]), pa.array(cols["h2"][o]), pa.array(inner[s].astype(np.int32) if len(s) else np.empty(0, np.int32)), pa.array((e - s).astype(np.int32))], names=["h1", "h2", "from_", "many_"])


#: Packed runs sorted at once, at least, if there are so many; whole buckets only, so at most this and a bucket.
_TOGETHER = 1024


def _count_buckets(spec: Spec) -> Callable:
    """Partitions sorted by mkey; whole buckets are sorted together, over batch ends, _TOGETHER runs or a few more at a time."""
    names = ["mkey", "h1", "h2", "low", "n"]

    def flush(table: pa.Table) -> pa.RecordBatch:
        return _bucket_result(spec, {c: table[c].to_numpy() for c in names}, table["packed"].to_pylist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            table = pa.Table.from_batches([b])
            held = pa.concat_tables([held, table]) if held is not None else table
            key = held["mkey"].to_numpy()
            lo = 0
            for c in (np.flatnonzero(key[1:] != key[:-1]) + 1).tolist():
                if c - lo >= _TOGETHER:
                    yield flush(held.slice(lo, c - lo))
                    lo = c
            held = held.slice(lo)
        if held is not None and held.num_rows:
            yield flush(held)

    return run


def _single_windows(spec: Spec) -> Callable:
    """Packed runs of hot buckets to one row a window, with two hashes; many runs at a time."""

    def part(b: pa.RecordBatch) -> pa.RecordBatch:
        n = b.column(4).to_numpy().astype(np.int64)
        values, row = token_values(spec, *K.joined(*K.string_parts(b.column(5).cast(pa.large_binary()).view(pa.large_string())), 0, b.num_rows))
        inside = row[: len(row) - spec.length + 1] == row[spec.length - 1 :]
        w1, w2 = (K.window_hash(K.prefix(hashed(values, k), k), spec.length, k)[inside] for k in range(2))
        owner = np.repeat(np.arange(len(n)), n)
        at = K.ranges(np.zeros(len(n), np.int64), n).astype(np.int32)
        return pa.RecordBatch.from_arrays([*(pa.array(b.column(c).to_numpy()[owner]) for c in range(4)), pa.array(at), pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64))], names=["mkey", "h1", "h2", "low", "at", "w1", "w2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                yield part(b.slice(i, 512))

    return run


def numbered(docs: DataFrame) -> tuple[DataFrame, bool]:
    """doc_id, text, doc (unique), and place (ordered as doc_id, null first, equal for rows of one doc_id) if it isn't doc.

    Where doc_id is unique and never null, as it should be, doc is doc_id.  Otherwise
    rows are numbered as they lie, without bringing those of one doc_id together.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1 OR doc_id IS NULL")
    if odd.isEmpty():
        return docs.withColumn("doc", F.col("doc_id")), False
    low = docs.agg(F.min("doc_id").alias("low")).first()["low"]
    least = 0 if low is None else low - 1
    if least >= -(1 << 63):
        return durable(docs.withColumn("doc", F.monotonically_increasing_id()).withColumn("place", F.coalesce("doc_id", F.lit(least).cast("long")))), True
    # The least long there is leaves no room below for null: ranks instead.
    ids = docs.select("doc_id").distinct().orderBy(F.col("doc_id").asc_nulls_first())
    place = durable(ids.rdd.zipWithIndex().map(lambda x: (x[0][0], x[1])).toDF("id long, place long"))
    rows = docs.withColumn("doc", F.monotonically_increasing_id()).join(place, F.col("doc_id").eqNullSafe(F.col("id")))
    return durable(rows.select("doc_id", "text", "doc", "place")), True


# -- the whole


def marks(spec: Spec, docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc, wins array<struct<start, n>>: runs of marked windows of each document that has any.

    docs: doc long (unique), text string, and place long if spec.placed.
    """
    found = describe(spec, docs)
    place = spec.place
    low, high = F.min(place).alias("a"), F.max(place).alias("b")
    shared = found.groupBy("mkey").agg(low, high) if spec.earlier else found.groupBy("mkey").agg(F.count("*").alias("c"))
    shared = shared.where("a < b" if spec.earlier else "c > 1").select("mkey")
    kept = durable(found.join(shared, "mkey"))
    runs = kept.groupBy("mkey", "h1", "h2").agg(F.min(F.struct(*dict.fromkeys((place, "doc", "start", "n")))).alias("one"), F.count("*").alias("many"))
    runs = runs.select("mkey", "h1", "h2", "one.*", "many")
    size = runs.groupBy("mkey").agg(F.count("*").alias("distinct_runs")).where("distinct_runs > 1")
    wanted = runs.join(size, "mkey").select("doc", F.struct("start", "n", "mkey", "h1", "h2", F.col(place).alias("low"), "many", (F.col("distinct_runs") > hot).alias("hot")).alias("w"))
    wanted = wanted.groupBy("doc").agg(F.collect_list("w").alias("wanted"))
    packed = docs.join(wanted.hint("shuffle_hash"), "doc").select("doc", "text", "wanted")
    packed = durable(packed.mapInArrow(_pack(spec), "mkey long, h1 long, h2 long, low long, many long, n int, hot boolean, packed binary"))
    cols = ["mkey", "h1", "h2", "low", "n", "packed"]
    schema = "h1 long, h2 long, from_ int, many_ int"
    inside = packed.where("not hot").select(cols).repartition("mkey").sortWithinPartitions("mkey").mapInArrow(_count_buckets(spec), schema)
    single = durable(packed.where("hot").select(cols).mapInArrow(_single_windows(spec), "mkey long, h1 long, h2 long, low long, at int, w1 long, w2 long"))
    if not single.isEmpty():
        by = ["mkey", "w1", "w2"]
        group = single.groupBy(by).agg(F.min("low").alias("least"), F.count("*").alias("c"))
        again = single.join(group, by).where("least < low" if spec.earlier else "c > 1")
        inside = inside.unionByName(again.select("h1", "h2", F.col("at").alias("from_"), F.lit(1).cast("int").alias("many_")))
    part = inside.groupBy("h1", "h2").agg(F.collect_list(F.struct(F.col("from_").alias("f"), F.col("many_").alias("m"))).alias("some"))
    # An occurrence is marked as a whole if it isn't the first one (or, of repeats, if there are several).
    whole = runs.where("many > 1").select("h1", "h2", F.col(place).alias("one"))
    rule = whole.join(part, ["h1", "h2"], "full")
    every = F.col("one").isNotNull() & ((F.col(place) > F.col("one")) if spec.earlier else F.lit(True))
    hit = kept.select("h1", "h2", *dict.fromkeys((place, "doc")), "start", "n").join(rule, ["h1", "h2"])
    wins = F.when(every, F.array(F.struct("start", "n"))).otherwise(F.transform(F.coalesce("some", F.array().cast("array<struct<f:int,m:int>>")), lambda x: F.struct((F.col("start") + x["f"]).alias("start"), x["m"].alias("n"))))
    return hit.select("doc", wins.alias("wins")).where(F.size("wins") > 0).groupBy("doc").agg(F.flatten(F.collect_list("wins")).alias("wins"))


def apply_marks(spec: Spec, docs: DataFrame, run: Callable, schema: str, hot: int = HOT) -> DataFrame:
    """docs (doc_id, text) with the marked windows of each row, through `run` (batches of doc_id, text, wins)."""
    lean(docs.sparkSession)
    rows, odd = numbered(docs)
    spec = replace(spec, placed=odd and spec.earlier)
    found = marks(spec, rows.select("doc", "text", *(["place"] if spec.placed else [])), hot)
    return rows.join(found.hint("shuffle_hash"), "doc", "left").select("doc_id", "text", "wins").mapInArrow(run, schema)


def marked_tokens(wins: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    """First and past-the-last token of each marked window run, row by row; None where there is none."""
    lo, flat = wins.offsets.to_numpy(), wins.values
    start, n = flat.field("start").to_numpy(zero_copy_only=False).astype(np.int64), flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
    for r in range(len(wins)):
        i, j = lo[r], lo[r + 1]
        yield (start[i:j], start[i:j] + n[i:j] + length - 1) if wins[r].is_valid and j > i else None
