"""Benchmark decontamination by winnowing.

Of each document's 5-word grams the one with the least hash in every 6 in a row
is kept (winnowing), so any shared run of 10 words shares a kept gram.  Kept
grams that some benchmark item keeps as well are hits; each is extended to the
10-word windows around it, and a window counts if the item has it.  Items of
fewer than 10 words are one window of their own length and are looked up at
every word, as winnowing guarantees nothing below 10.

Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z
lower-cased.  Windows are equal if two 64-bit hashes are, each built on a word hash
of its own.  Equal windows of many items are one class, looked up once.

Up to `SHARE_WORDS` benchmark words (counted first) the benchmark's hashes go to
every task; beyond that `by_join` joins fingerprints and windows by shuffles, with
rows numbered first. Both give the same result for any input; documents are judged row by row.

Defined cases: a null or empty text has no words, hits or items; very long texts
are taken whole; repeated doc_ids, null ones and repeated rows are documents of their own; benchmark rows
with a null id or no words take no part; repeated ids are one item; an empty
benchmark leaves everything clean, no documents give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .session import durable, lean

WINDOW, GRAM = 10, 5
GUARD = WINDOW - GRAM + 1
#: Benchmark words whose hashes may be broadcast (16 bytes each).
SHARE_WORDS = 2_000_000


def _pairs(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of every window of n words; h: both hashes of the words, (2, words)."""
    return K.window_hash(K.prefix(h[0], 0), n, 0), K.window_hash(K.prefix(h[1], 1), n, 1)


def _grams(h: np.ndarray) -> np.ndarray:
    return K.window_hash(K.prefix(h[0], 0), GRAM, 0)


def _winnow(grams: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Positions of the grams that are least in some window of GUARD inside their row (row: of each word)."""
    n = len(grams)
    if n < GUARD:
        return np.empty(0, np.int64)
    least = K.sliding_min(grams, GUARD)
    inside = row[: len(least)] == row[WINDOW - 1 : WINDOW - 1 + len(least)]
    # A gram is kept if it equals the minimum of one of the windows that hold it.
    kept = np.zeros(n, bool)
    for k in range(GUARD):
        part = kept[k : k + len(least)]
        part |= inside & (grams[k : k + len(least)] == least)
    return np.flatnonzero(kept)


class Index:
    """Hashes of a benchmark: winnowed grams, and distinct windows (classes) with their items."""

    def __init__(self, items: list[tuple[str, np.ndarray]]):
        self.names = sorted({name for name, _ in items})
        number = {x: i for i, x in enumerate(self.names)}
        grams, by_len = [], {}
        for name, h in items:
            n = min(h.shape[1], WINDOW)
            if not n:
                continue
            a, b = _pairs(h, n)
            by_len.setdefault(n, []).append((a, b, np.full(len(a), number[name])))
            if n == WINDOW:
                g = _grams(h)
                grams.append(g[_winnow(g, np.zeros(h.shape[1], np.int64))])
        self.grams = np.unique(np.concatenate(grams)) if grams else np.empty(0, np.uint64)
        self.by_len, owners, base = {}, [], 0
        for n, parts in by_len.items():
            a, b, item = (np.concatenate([p[k] for p in parts]) for k in range(3))
            order = np.lexsort((item, b, a))
            a, b, item = a[order], b[order], item[order]
            new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            self.by_len[n] = (a[new], b[new], base)
            owners.append(np.stack((np.cumsum(new) - 1 + base, item)))
            base += int(new.sum())
        owner, self.items = np.concatenate(owners, axis=1) if owners else np.empty((2, 0), np.int64)
        self.cut = np.searchsorted(owner, np.arange(base + 1))

    def items_of(self, classes: np.ndarray) -> list[str]:
        """Sorted names of the items with any of these windows."""
        classes = np.unique(classes)
        return sorted(self.names[x] for x in np.unique(self.items[K.ranges(self.cut[classes], self.cut[classes + 1] - self.cut[classes])]).tolist())

    def lookup(self, n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the given windows, class) for all that occur."""
        ha, hb, base = self.by_len[n]
        lo = np.searchsorted(ha, a, "left")
        count = np.searchsorted(ha, a, "right") - lo
        which, at = np.repeat(np.arange(len(a)), count), K.ranges(lo, count)
        good = hb[at] == b[which]
        return which[good], at[good] + base

    def hits(self, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, length and class of every occurrence in joined rows."""
        found = []
        for n in self.by_len:
            m = len(row) - n + 1
            if m <= 0:
                continue
            if n == WINDOW:
                grams = _grams(h)
                at = _winnow(grams, row)
                at = at[np.isin(grams[at], self.grams)]
                start = (at[:, None] - np.arange(GUARD)).ravel()  # extend: every window around the gram
                start = np.unique(start[(start >= 0) & (start < m)])
            else:
                start = np.arange(m)
            start = start[row[start] == row[start + n - 1]]
            if len(start):
                a, b = _pairs(h, n)
                which, cls = self.lookup(n, a[start], b[start])
                found.append((start[which], np.full(len(which), n), cls))
        if not found:
            z = np.empty(0, np.int64)
            return z, z, z
        return tuple(np.concatenate([f[k] for f in found]) for k in range(3))


def _word_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    off, raw = K.string_parts(column)
    for i, j in K.slices(off):
        buf, at = K.joined(off, raw, i, j)
        _, _, h, row = K.words(buf, at, K.ALNUM, lower=True, two=True)
        yield i, j, h, row


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[list] = [[], []]
        for i, j, h, row in _word_slices(b.column(1)):
            cut = np.searchsorted(row, np.arange(j - i + 1))
            for w in range(2):
                out[w] += [h[w, cut[k] : cut[k + 1]].view(np.int64) for k in range(j - i)]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.list_(pa.int64())) for x in out)], names=["item_id", "h", "g"])


def item_words(benchmark: DataFrame) -> DataFrame:
    """item_id, h, g: both hashes of the words of each item that has any."""
    lean(benchmark.sparkSession)
    rows = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), "text")
    return rows.mapInArrow(_item_words, "item_id string, h array<long>, g array<long>").where(F.size("h") > 0)


def shared_index(items: DataFrame) -> Index:
    """items: of item_words, known to be at most SHARE_WORDS words."""
    return Index([(r["item_id"], np.array([r["h"], r["g"]], np.int64).view(np.uint64)) for r in items.collect()])


_SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def by_broadcast(docs: DataFrame, items: DataFrame) -> DataFrame:
    """items: of item_words, known to be at most SHARE_WORDS words."""
    shared = docs.sparkSession.sparkContext.broadcast(shared_index(items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        empty = hashlib.sha256(b"").hexdigest()
        for b in batches:
            n = b.num_rows
            n_words, n_hit, n_items, sha = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), [empty] * n
            for i, j, h, row in _word_slices(b.column(1)):
                n_words[i:j] = np.bincount(row, minlength=j - i)
                start, size, cls = index.hits(h, row)
                if len(start):
                    n_hit[i:j] = np.bincount(row[K.cover(len(row), start, start + size)], minlength=j - i)
                    of = row[start]
                    for r in np.unique(of).tolist():
                        names = index.items_of(cls[of == r])
                        n_items[i + r], sha[i + r] = len(names), hashlib.sha256(",".join(names).encode()).hexdigest()
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (n_words, n_hit, n_items, sha, n_hit > 0))], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _SCHEMA)


#: Column of row numbers on the way through joins.
_ROW = "row_number_"


def _emit_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column(0).to_numpy()
        for i, j, h, row in _word_slices(b.column(1)):
            g = _grams(h)
            at = _winnow(g, row)
            yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][row[at]]), pa.array(g[at].view(np.int64))], names=[_ROW, "gram"])


def _emit_windows(lengths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for i, j, h, row in _word_slices(b.column(1)):
                for n in lengths:
                    m = len(row) - n + 1
                    if m > 0:
                        start = np.flatnonzero(row[:m] == row[n - 1 :])
                        x, y = _pairs(h, n)
                        pos = start - np.searchsorted(row, row[start])
                        yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][row[start]]), pa.array(pos), pa.array(np.full(len(start), n)), pa.array(x[start].view(np.int64)), pa.array(y[start].view(np.int64))], names=[_ROW, "pos", "n", "a", "b"])

    return run


def _emit_item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for name, h, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            h = np.array([h, g], np.int64).view(np.uint64)
            n = min(h.shape[1], WINDOW)
            x, y = _pairs(h, n)
            g = _grams(h) if n == WINDOW else x[:0]
            grams = [[] for _ in x]
            if len(g):
                grams[0] = g[_winnow(g, np.zeros(h.shape[1], np.int64))].view(np.int64).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(x)), pa.array(np.full(len(x), n)), pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), pa.array(grams, pa.list_(pa.int64()))], names=["item_id", "n", "a", "b", "grams"])


def _named(spots: DataFrame, owners: DataFrame) -> DataFrame:
    """Row, n_items, items_sha256 from spots (row, class) and owners (class, item_id).

    Rows that hold the same set of windows are answered together, so a window in many
    rows and many items isn't paired off.
    """
    sets = durable(spots.select(_ROW, "class").distinct().groupBy(_ROW).agg(F.array_sort(F.collect_list("class")).alias("classes")))
    each = sets.select("classes").distinct().select("classes", F.explode("classes").alias("class"))
    items = each.join(owners, "class").select("classes", "item_id").distinct().groupBy("classes")
    items = items.agg(F.count("*").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("item_id"))).cast("binary"), 256).alias("items_sha256"))
    return sets.join(items, "classes").select(_ROW, "n_items", "items_sha256")


def by_join(docs: DataFrame, items: DataFrame, number: str | None = None) -> DataFrame:
    """The same result for a benchmark of any size, without a broadcast of ours; number: a column of row numbers, which is returned as well, if docs has one."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(number).alias(_ROW)) if number else durable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias(_ROW)))
    text = docs.select(_ROW, "text")
    wins = durable(items.mapInArrow(_emit_item_windows, "item_id string, n long, a long, b long, grams array<long>"))
    classes = durable(wins.select("n", "a", "b").distinct().withColumn("class", F.monotonically_increasing_id()))
    owners = wins.join(classes, ["n", "a", "b"]).select("class", "item_id").distinct()
    lengths = [r["n"] for r in classes.select("n").distinct().collect()]  # at most WINDOW values
    short = [n for n in lengths if n < WINDOW]
    schema = f"{_ROW} long, pos long, n long, a long, b long"
    parts = []
    if WINDOW in lengths:
        grams = wins.select(F.explode("grams").alias("gram")).distinct()
        hit = text.mapInArrow(_emit_grams, f"{_ROW} long, gram long").join(grams, "gram", "left_semi").select(_ROW).distinct()
        parts.append(text.join(hit, _ROW, "left_semi").mapInArrow(_emit_windows([WINDOW]), schema))
    if short:
        parts.append(text.mapInArrow(_emit_windows(short), schema))
    counts = docs.select(_ROW, "doc_id", "text").mapInArrow(_count_words, f"{_ROW} long, doc_id long, n_words long")
    none, zero = F.sha2(F.lit("").cast("binary"), 256), F.lit(0).cast("long")
    more = [F.col(_ROW).alias(number)] if number else []
    if not parts:
        return counts.select("doc_id", "n_words", zero.alias("n_hit"), zero.alias("n_items"), none.alias("items_sha256"), F.lit(False).alias("contaminated"), *more)
    spots = durable(reduce(DataFrame.unionByName, parts).join(classes, ["n", "a", "b"]).select(_ROW, "pos", "n", "class"))
    covered = spots.select(_ROW, F.explode(F.sequence("pos", F.col("pos") + F.col("n") - 1)).alias("w")).distinct().groupBy(_ROW).agg(F.count("*").alias("n_hit"))
    return (
        counts.join(covered, _ROW, "left")
        .join(_named(spots, owners), _ROW, "left")
        .select("doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"), *more)
    )


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = np.zeros(b.num_rows, np.int64)
        for i, j, _, row in _word_slices(b.column(2)):
            n[i:j] = np.bincount(row, minlength=j - i)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n)], names=[_ROW, "doc_id", "n_words"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, share_words: int = SHARE_WORDS) -> DataFrame:
    items = item_words(benchmark)
    total = items.agg(F.sum(F.size("h") + 8).alias("n")).first()["n"] or 0
    return by_broadcast(docs, items) if total <= share_words else by_join(docs, items)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, share_words: int = SHARE_WORDS) -> DataFrame:
    """The rows of docs without any benchmark window, in their columns.

    With a shared benchmark rows are filtered where they are read; else rows are numbered
    and the numbers of contaminated ones anti-joined.
    """
    items = item_words(benchmark)
    total = items.agg(F.sum(F.size("h") + 8).alias("n")).first()["n"] or 0
    if total > share_words:
        rows = durable(docs.withColumn("kept_row_", F.monotonically_increasing_id()))
        gone = by_join(rows, items, "kept_row_").where("contaminated").select("kept_row_")
        return rows.join(gone, "kept_row_", "left_anti").select(docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(shared_index(items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            clean = np.ones(b.num_rows, bool)
            for i, _, h, row in _word_slices(b.column(b.schema.get_field_index("text"))):
                clean[i + row[index.hits(h, row)[0]]] = False
            yield b.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
iwin AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS s
         FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iwin),
dwin AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS s
         FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw, sizes WHERE len(w) >= n)),
hit AS (SELECT d.doc_id, d.p, d.n, i.item_id FROM dwin d JOIN iwin i ON d.n = i.n AND d.s = i.s),
cov AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov ON dw.doc_id = cov.doc_id LEFT JOIN its ON dw.doc_id = its.doc_id
"""
