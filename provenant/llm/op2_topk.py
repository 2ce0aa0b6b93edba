"""Exact top-k search by distributed histogram selection.

Vectors become integers, floor(1024 * x).  Queries go in blocks; for a block
every row is scored (one matrix product a batch) and each query's scores are
counted in a histogram over the range its norm allows.  The histogram is refined
inside the bin that holds the kth value until a bin is one score wide; a last
pass keeps the scores above that value, and of those equal to it the least
vec_ids that are still needed.  No score is kept between passes.

A task sends the bins from its own kth best score upwards only: lower ones can't
hold the kth best of all.  What it sends is so at most k bins or rows a query.

Defined cases: null vectors and ones with a null, NaN or infinite component take
no part, nor do rows with a null vec_id; vectors of another length than the
query's aren't candidates for it; ties go to the smaller vec_id; of rows that
repeat a query's vec_id the least vector is the query and none is a candidate;
other repeated rows are all candidates; fewer than k candidates are all returned;
extra columns are ignored; a score beyond 64 bits raises OverflowError.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .session import durable

K_BEST = 10
SCALE = 1024.0
#: Queries of a block at most, and bytes of their matrix, which is broadcast.
BLOCK, BLOCK_BYTES = 16_384, 32 << 20
#: Bins of a query's histogram at most, and cells of a block's histograms: many queries share a scan with fewer bins each.
BINS, HISTOGRAM_CELLS = 2048, 1 << 22
#: Scores held at once.
CELLS = 1 << 22


def vectors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and integer vectors (as float64) of a batch's valid rows, by length."""
    ids, lists = batch.column(0), batch.column(1)
    flat = lists.values
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    lo = lists.offsets.to_numpy().astype(np.int64)
    size = np.diff(lo)
    bad = ~np.isfinite(values)  # a null became NaN
    wrong = np.concatenate(([0], np.cumsum(bad)))
    good = (wrong[lo[1:]] == wrong[lo[:-1]]) & ids.is_valid().to_numpy(zero_copy_only=False) & lists.is_valid().to_numpy(zero_copy_only=False)
    ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
    for d in np.unique(size[good]):
        rows = np.flatnonzero(good & (size == d))
        yield ids[rows], np.floor(SCALE * values[lo[rows][:, None] + np.arange(d)])


@dataclass
class Block:
    """Queries of one length (dim): ids, integer vectors, and what is known of each kth score."""

    ids: np.ndarray
    vectors: np.ndarray
    low: np.ndarray  # the kth score is in [low, low + width)
    width: np.ndarray
    exact: bool = True
    bins: int = BINS


def _scores(block: Block, ids: np.ndarray, vecs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Candidate ids, scores (queries x candidates, int64) and which of them count."""
    step = max(1, CELLS // max(1, len(block.ids)))
    for i in range(0, len(ids), step):
        part = vecs[i : i + step]
        if block.exact:
            s = (block.vectors @ part.T).astype(np.int64)
        else:
            s = block.vectors.astype(np.int64) @ part.T.astype(np.int64)
        yield ids[i : i + step], s, block.ids[:, None] != ids[None, i : i + step]


def _histogram(shared, dim: int, k: int):
    """query (its number), bin, n: from the task's own kth bin up, bins of equal width in [low, low + width); the last: above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        q, bins = len(block.ids), block.bins
        total = np.zeros((q, bins + 1), np.int64)
        fine = -(-block.width // bins)
        for b in batches:
            for ids, vecs in vectors(b):
                if vecs.shape[1] != dim:
                    continue
                for _, s, counts in _scores(block, ids, vecs):
                    at = np.minimum((s - block.low[:, None]) // fine[:, None], bins)
                    at[s >= (block.low + block.width)[:, None]] = bins
                    r, c = np.nonzero(counts & (s >= block.low[:, None]))
                    total += np.bincount(r * (bins + 1) + at[r, c], minlength=total.size).reshape(total.shape)
        above = np.cumsum(total[:, ::-1], axis=1)[:, ::-1] - total  # in higher bins
        r, c = np.nonzero((total > 0) & (above < k))
        yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(c), pa.array(total[r, c])], names=["query", "bin", "n"])

    return run


def _select(shared, dim: int, k: int):
    """query, vec_id, score: all above the kth score, and the least ids of the task at it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        ties: dict[int, np.ndarray] = {}
        names = ["query", "vec_id", "score"]
        for b in batches:
            for ids, vecs in vectors(b):
                if vecs.shape[1] != dim:
                    continue
                for part, s, counts in _scores(block, ids, vecs):
                    r, c = np.nonzero(counts & (s > block.low[:, None]))
                    yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(part[c]), pa.array(s[r, c])], names=names)
                    r, c = np.nonzero(counts & (s == block.low[:, None]))
                    cut = np.searchsorted(r, np.arange(len(block.ids) + 1))
                    for x in np.unique(r):
                        ties[int(x)] = np.sort(np.concatenate((ties.get(int(x), part[:0]), part[c[cut[x] : cut[x + 1]]])))[:k]
        r = np.repeat(np.array([*ties], np.int64), [len(v) for v in ties.values()])
        yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(np.concatenate([*ties.values()]) if ties else np.empty(0, np.int64)), pa.array(block.low[r])], names=names)

    return run


def _norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    best: dict[int, float] = {}
    for b in batches:
        for _, v in vectors(b):
            best[v.shape[1]] = max(best.get(v.shape[1], 0.0), float(np.sqrt((v * v).sum(axis=1)).max(initial=0.0)))
    yield pa.RecordBatch.from_arrays([pa.array([*best], pa.int32()), pa.array([*best.values()], pa.float64())], names=["dim", "norm"])


def _search_block(rows: DataFrame, ids: np.ndarray, vecs: np.ndarray, most: float, k: int) -> DataFrame:
    sc = rows.sparkSession.sparkContext
    dim = vecs.shape[1]
    reach = np.ceil(np.sqrt((vecs * vecs).sum(axis=1)) * most * (1 + 1e-12)) + 1  # |score| is below this
    if reach.max(initial=0) >= 2.0**62:
        raise OverflowError("a score may not fit 64 bits")
    reach = reach.astype(np.int64)
    block = Block(ids, vecs, -reach, 2 * reach + 1, bool(reach.max(initial=0) < 2**52), max(2, min(BINS, HISTOGRAM_CELLS // len(ids))))
    need = np.full(len(ids), k, np.int64)
    few = np.zeros(len(ids), bool)
    while (block.width > 1).any():
        shared = sc.broadcast(block)
        bins = rows.mapInArrow(_histogram(shared, dim, k), "query long, bin long, n long").groupBy("query", "bin").agg(F.sum("n").alias("n"))
        down = bins.withColumn("upto", F.sum("n").over(Window.partitionBy("query").orderBy(F.desc("bin"))))
        # The bin of each query's kth score; without one it has fewer candidates.
        kth = down.where(F.col("upto") >= k).groupBy("query").agg(F.max("bin").alias("bin"))
        found = kth.toPandas()  # one row a query of the block
        fine = -(-block.width // block.bins)
        new = np.full(len(ids), -1, np.int64)
        new[found["query"].to_numpy(np.int64)] = found["bin"].to_numpy(np.int64)
        few |= new < 0
        low = np.where(few, block.low, block.low + new * fine)
        width = np.where(few, 1, np.minimum(fine, block.low + block.width - low))
        block = Block(ids, vecs, low, width, block.exact, block.bins)
        shared.unpersist()
    block.low = np.where(few, -reach - 1, block.low)
    shared = sc.broadcast(block)
    hits = rows.mapInArrow(_select(shared, dim, k), "query long, vec_id long, score long")
    best = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    names = rows.sparkSession.createDataFrame([(i, int(x)) for i, x in enumerate(ids)], "query long, query_id long")
    return best.join(F.broadcast(names), "query").select("query_id", "rank", "vec_id", "score")  # names: at most BLOCK rows


def _query_blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Queries in order, in blocks of one length and of at most BLOCK rows and BLOCK_BYTES."""
    open_: dict[int, list] = {}

    def done(rows: list) -> tuple[np.ndarray, np.ndarray]:
        return np.array([r[0] for r in rows], np.int64), np.floor(SCALE * np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1))

    seen = None
    for r in queries.orderBy("vec_id", "embedding").toLocalIterator():
        v = r["embedding"]
        if r["vec_id"] == seen or any(x is None or x != x or abs(x) == float("inf") for x in v):
            continue
        seen = r["vec_id"]
        rows = open_.setdefault(len(v), [])
        rows.append((seen, v))
        if len(rows) >= min(BLOCK, max(1, BLOCK_BYTES // (8 * max(1, len(v))))):
            yield done(open_.pop(len(v)))
    for rows in open_.values():
        yield done(rows)


def top_k(rows: DataFrame, queries: DataFrame, k: int = K_BEST) -> DataFrame:
    """query_id, rank, vec_id, score, for rows and queries with columns vec_id, embedding."""
    kind = "array<double>" if dict(rows.dtypes)["embedding"] == "array<double>" else "array<float>"
    shape = lambda df: df.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    rows, queries = shape(rows), shape(queries)
    most = {r["dim"]: r["norm"] for r in rows.mapInArrow(_norms, "dim int, norm double").groupBy("dim").agg(F.max("norm").alias("norm")).collect()}  # one row a vector length
    parts = [durable(_search_block(rows, ids, vecs, most.get(vecs.shape[1], 0.0), k)) for ids, vecs in _query_blocks(queries)]
    if not parts:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return reduce(DataFrame.unionByName, parts)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(rows, rows.where("vec_id % 100 = 0"))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
