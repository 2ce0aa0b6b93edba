"""Mixing sources to target weights: temperature, then budgeted block permutations.

Weights are source token shares to a power a in [0, 1], normalised: a = 1 keeps
the shares, a = 0 is uniform.  The power is bisected to the least a at which no
source is read more than `max_repeat` times (default), or at which the entropy
of the weights meets a target; a target below the entropy of the plain shares or
above that of equal weights can't be met and is an error, and so is a limit given
beside a target, or a budget, that can't be kept.  With no budget given, the smallest one that shows
every document at least once is taken: the source with the largest share per
weight is read exactly once.

A source with budget b and t tokens is read b / t times.  Its documents lie in
blocks (by a hash of doc_id); every pass (epoch) over a source is a permutation of
its blocks, drawn by a hash of seed, epoch and block, and of the documents inside
each block.  Whole passes come first; of the last one, blocks are taken in
order while they fit, and of the block at the boundary the documents that fit.
Only blocks (of about `block_tokens` tokens) are ranked per source, documents only
inside boundary blocks, so no source is ever sorted as a whole.

Tokens here are runs of non-blank characters, as the pipeline's mixing needs
no tokenizer; a column of counts can be given instead.

Defined cases: a null source is a source of its own; a null or empty text has
0 tokens, and a source without tokens is read once; repeated rows are rows
of their own; a null doc_id is hashed as such; an empty table gives an empty
result; columns that clash (n_tokens, epoch, block) in the input are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .session import durable

MAX_REPEAT = 4.0
BLOCK_TOKENS = 1 << 16
#: Blocks of a source at most; beyond, blocks grow (ranked in one task a source).
MOST_BLOCKS = 1 << 16
#: Sources that are planned on the driver at most; more are an error.
MOST_SOURCES = 1_000_000
SEED = 11
STEPS = 60


@dataclass(frozen=True)
class Mix:
    power: float
    weights: dict[str | None, float]
    repeats: dict[str | None, float]


def shares_to(shares: list[float], power: float) -> list[float]:
    """Normalised shares to a power; shares of 0 stay 0."""
    raised = [math.exp(power * math.log(s)) if s > 0 else 0.0 for s in shares]
    total = math.fsum(raised)
    return [r / total for r in raised] if total else raised


def entropy(weights: list[float]) -> float:
    return -math.fsum(w * math.log(w) for w in weights if w > 0)


def _search(fits) -> float:
    """The least power in [0, 1] that fits, if 1 does; fits holds from some power on."""
    if fits(0.0):
        return 0.0
    lo, hi = 0.0, 1.0
    for _ in range(STEPS):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if fits(mid) else (mid, hi)
    return hi


def bisect(shares: list[float], max_repeat: float | None = MAX_REPEAT, target_entropy: float | None = None, spread: float | None = None) -> float:
    """The least power (flattest weights) that keeps to the repetition limit, or that which meets the entropy.

    spread: budget over tokens; without one the source with the largest share per weight is read once.
    """
    some = [s for s in shares if s > 0]
    if not some:
        return 0.0

    def most(power: float) -> tuple[float, float]:
        """How often a source is read at most, as a fraction."""
        per = [a / s for a, s in zip(shares_to(some, power), some)]
        return (max(per) * spread, 1.0) if spread is not None else (max(per), min(per))

    def repeats(power: float) -> float:
        a, b = most(power)
        return a / b

    def keeps(power: float) -> bool:
        a, b = most(power)
        return a <= max_repeat * b

    if target_entropy is None:
        if max_repeat is None:
            return 0.0
        if repeats(1.0) > max_repeat * (1 + 1e-12):
            raise ValueError(f"the budget reads every source {repeats(1.0):.4g} times at least, the limit is {max_repeat}")
        return _search(keeps)
    low, high = entropy(some), math.log(len(some))
    if not low - 1e-9 <= target_entropy <= high + 1e-9:
        raise ValueError(f"weights of these shares have an entropy from {low:.6g} to {high:.6g}, not {target_entropy}")
    power = _search(lambda p: entropy(shares_to(some, p)) <= target_entropy)
    if max_repeat is not None and repeats(power) > max_repeat * (1 + 1e-9):
        raise ValueError(f"at that entropy a source is read {repeats(power):.4g} times, the limit is {max_repeat}")
    return power


def plan(tokens: dict[str | None, int], max_repeat: float | None = None, target_entropy: float | None = None, budget: int | None = None) -> Mix:
    """Weights, and how often each source is read; MAX_REPEAT is the limit if neither one nor an entropy is given."""
    if max_repeat is None and target_entropy is None:
        max_repeat = MAX_REPEAT
    total = sum(tokens.values())
    names = list(tokens)
    shares = [tokens[n] / total if total else 0.0 for n in names]
    spread = budget / total if budget is not None and total else None
    power = bisect(shares, max_repeat, target_entropy, spread)
    weights = shares_to(shares, power)
    per = [w / s for w, s in zip(weights, shares) if s > 0]
    scale = spread if spread is not None else (1 / min(per) if per else 0.0)
    repeats = {n: (w / s * scale if s > 0 else 1.0) for n, w, s in zip(names, weights, shares)}
    return Mix(power, dict(zip(names, weights)), repeats)


def n_tokens(text: str = "text") -> F.Column:
    """Runs of non-blank characters, counted without building them."""
    starts = F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"))
    return F.coalesce(starts, F.lit(0)).cast("long")


def _hash(*cols: F.Column) -> F.Column:
    """60 bits of an MD5, so that any engine can redraw the permutations."""
    text = F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in cols))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, max_repeat: float | None = None, target_entropy: float | None = None, budget: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = SEED, tokens: str | None = None) -> DataFrame:
    """doc_id, source, n_tokens, epoch, block, block_rank, place: one row for each time a document is read.

    Reading order of a source: epoch, block_rank, place (hashes; ties by block and doc_id).
    """
    count = F.col(tokens).cast("long") if tokens else n_tokens()
    rows = docs.select("doc_id", "source", count.alias("n_tokens"))
    rows = durable(rows)
    sums = {r["source"]: (r["t"], r["n"]) for r in rows.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()}  # one row a source
    if len(sums) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources; mix groups of them")
    order = sorted(sums, key=lambda s: (s is not None, s or ""))
    mixed = plan({s: sums[s][0] for s in order}, max_repeat, target_entropy, budget)
    shape = []
    for s in order:
        t, _ = sums[s]
        whole = math.floor(mixed.repeats[s] + 1e-9)
        rest = max(0, math.floor((mixed.repeats[s] - whole) * t + 1e-3))  # whole quotas stay whole
        shape.append((s, whole, rest, min(MOST_BLOCKS, max(1, -(-t // block_tokens)))))
    spark = docs.sparkSession
    # One row a source, so small; the planner still chooses, as sources are not bounded by proof.
    sources = spark.createDataFrame(shape, "source string, whole int, rest long, blocks long").withColumnRenamed("source", "s")
    rows = rows.join(sources, F.col("source").cast("string").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("block", _hash(F.lit(seed), F.col("doc_id")) % F.col("blocks"))
    full = rows.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)))
    last = rows.where("rest > 0").withColumn("epoch", F.col("whole"))
    rank = _hash(F.lit(seed), F.col("source"), F.col("epoch"), F.col("block"))
    place = _hash(F.lit(seed + 1), F.col("doc_id"), F.col("epoch"))
    # The last pass: blocks in order while they fit, then documents of the boundary block.
    last = last.withColumn("block_rank", rank).withColumn("place", place)
    key = ["source", "block"]
    block = last.groupBy(*key, "block_rank", "rest").agg(F.sum("n_tokens").alias("size"))
    block = block.withColumn("before", F.sum("size").over(Window.partitionBy("source").orderBy("block_rank", "block")) - F.col("size")).where("before < rest")
    block = block.select(F.col("source").alias("s"), F.col("block").alias("b"), "before", (F.col("before") + F.col("size") <= F.col("rest")).alias("fits"))
    last = last.join(block, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    edge = last.where("not fits").withColumn("upto", F.col("before") + F.sum("n_tokens").over(Window.partitionBy(*key).orderBy("place", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0))).where("upto <= rest")
    cols = ["doc_id", "source", "n_tokens", "epoch", "block", "block_rank", "place"]
    full = full.withColumn("block_rank", rank).withColumn("place", place)
    return full.select(cols).unionByName(last.where("fits").select(cols)).unionByName(edge.select(cols))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE r AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
t AS (SELECT source, CAST(sum(n_tokens) AS DOUBLE) AS t FROM r GROUP BY source),
sh AS (SELECT source, t, t / (SELECT sum(t) FROM t) AS s FROM t),
l AS (SELECT list(s) AS ss FROM sh WHERE s > 0),
bis AS (
  SELECT 0 AS step, CAST(0 AS DOUBLE) AS lo, CASE WHEN list_max(ss) <= 4 * list_min(ss) THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS hi FROM l
  UNION ALL
  SELECT step + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END
  FROM (SELECT step, lo, hi, (lo + hi) / 2 AS mid,
               list_max(list_transform(ss, lambda x: exp((lo + hi) / 2 * ln(x)) / x)) <= 4 * list_min(list_transform(ss, lambda x: exp((lo + hi) / 2 * ln(x)) / x)) AS ok
        FROM bis, l WHERE step < 60)),
p AS (SELECT hi AS power FROM bis ORDER BY step DESC LIMIT 1),
w AS (SELECT source, t, s, CASE WHEN s > 0 THEN exp(power * ln(s)) END AS e FROM sh, p),
rep AS (SELECT source, t, CASE WHEN s > 0 THEN e / s / (SELECT min(e / s) FROM w) ELSE 1 END AS rep FROM w),
plan AS (SELECT source, t, CAST(floor(rep + 1e-9) AS BIGINT) AS whole, greatest(0, CAST(floor((rep - floor(rep + 1e-9)) * t + 1e-3) AS BIGINT)) AS rest,
                least(65536, greatest(1, CAST(ceil(t / 65536) AS BIGINT))) AS blocks FROM rep),
d AS (SELECT r.*, whole, rest, CAST(CAST('0x' || md5('11|' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:15] AS BIGINT) % blocks AS BIGINT) AS block
      FROM r JOIN plan ON r.source IS NOT DISTINCT FROM plan.source),
e AS (SELECT *, unnest(range(0, whole + (rest > 0)::INT)) AS epoch FROM d),
x AS (SELECT *, CAST('0x' || md5('11|' || coalesce(source, '') || '|' || epoch || '|' || block)[1:15] AS BIGINT) AS block_rank,
             CAST('0x' || md5('12|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || epoch)[1:15] AS BIGINT) AS place FROM e),
y AS (SELECT *, CASE WHEN epoch < whole THEN 0 ELSE sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY block_rank, block, place, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS upto FROM x)
SELECT doc_id, source, n_tokens, CAST(epoch AS INTEGER) AS epoch, block, block_rank, place FROM y WHERE epoch < whole OR upto <= rest
"""
