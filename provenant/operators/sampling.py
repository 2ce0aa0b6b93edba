"""Samples for human evaluation: stratified by quota, and greedy by diversity.

Draws are by hash, so they are the same for any partitioning.  Quotas are row-number
limits, which Spark pushes below the shuffle; the greedy choice works on counts of
label combinations, not on rows, so no stratum is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from random import Random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import dims
from .literal import literal

PER_MODEL = dict(ASF1=4, ASF5=10)
PER_LABEL = dict.fromkeys(("ASF2", "ASF3", "ASF4"), 20)
SEED = 42


def _quota(axis: str) -> dict[str, int]:
    sizes = {"QI": "40 " * 5, "SD": "20 " * 10, "ST": "33 33 34 34 33 33", "SP": "33 34 33 33 34 33"}[axis]
    return {f"{axis}{i}": int(n) for i, n in enumerate(sizes.split(), 1)}


QUOTAS = {a: _quota(a) for a in "QI ST SD SP".split()}
DIVERSITY = {"QI": ["category"]} | {a: [f"{b}_label" for b in others.split()] for a, others in (("ST", "SD SP"), ("SD", "ST SP"), ("SP", "ST SD"))}
SUBJECT = {"QI": "query_id"} | dict.fromkeys(("ST", "SD", "SP"), "url_id")


def draw(seed: int, *key: str) -> Column:
    """A pseudo-random string of a row's key, the same in any engine with MD5."""
    text = F.concat_ws("|", F.lit(seed), *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key))
    return F.md5(text.cast("binary"))


def stratified(df: DataFrame, strata: Sequence[str], quota: dict[tuple, int], key: Sequence[str], seed: int = SEED) -> DataFrame:
    """At most quota[stratum] rows of each stratum (all if it has no more), by hash order."""
    limit = None
    for values, n in quota.items():
        cond = None
        for c, v in zip(strata, values):
            cond = (F.col(c) == v) if cond is None else cond & (F.col(c) == v)
        limit = F.when(cond, n) if limit is None else limit.when(cond, n)
    most = max(quota.values())
    rows = df.withColumn("_q", limit).where("_q IS NOT NULL").withColumn("_d", draw(seed, *key))
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy("_d", *key))
    return rows.withColumn("_n", rank).where(F.col("_n") <= most).where("_n <= _q").drop("_q", "_d", "_n")


def fidelity_sample(am: DataFrame, key: Sequence[str], seed: int = SEED) -> DataFrame:
    """layer, model_short, ASF_label and key: quotas per model and verdict, then per kind of distortion."""
    cols = [*dict.fromkeys(("model_short", "ASF_label", *key))]
    one = stratified(am, ("model_short", "ASF_label"), {(m, a): n for m in dims.SHORT for a, n in PER_MODEL.items()}, key, seed)
    two = stratified(am, ("ASF_label",), {(a,): n for a, n in PER_LABEL.items()}, key, seed + 1)
    return one.select(F.lit(1).alias("layer"), *cols).unionByName(two.select(F.lit(2).alias("layer"), *cols))


def numbered(sample: DataFrame, axis: str, order: Sequence[Column | str]) -> DataFrame:
    """A sample (a few hundred rows) with item_id: the axis and the place in the given order."""
    return sample.withColumn("item_id", F.concat(F.lit(axis), F.row_number().over(Window.partitionBy().orderBy(*order))))


def one_query_each(queries: DataFrame, intents: Sequence[str] = ("QI1", "QI2", "QI4"), seed: int = SEED) -> DataFrame:
    return stratified(queries, ("QI_label",), {(q,): 1 for q in intents}, ("query_id",), seed)


def pool(am: DataFrame, axis: str) -> DataFrame:
    """One row a subject with its label and diversity columns: its first by cit_id, or the least if there are no cit_ids."""
    key, cols = SUBJECT[axis], [f"{axis}_label", *DIVERSITY[axis]]
    order = [*(["cit_id"] if "cit_id" in am.columns else []), *cols]
    rows = am.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("r")).select(key, "r.*")
    return rows.where(F.col(f"{axis}_label").isin(*QUOTAS[axis]))


def choose(cells: dict[tuple, int], n: int, rnd: Random) -> dict[tuple, int]:
    """How many rows to take of each combination: n times that of the largest sum of 1 / (times its value was taken + 1), plus jitter below 0.1.

    The best of m jitters, one a row, is 0.1 * U ** (1 / m), so rows needn't be seen.
    """
    left, taken = dict(sorted(cells.items(), key=str)), dict.fromkeys(cells, 0)
    seen: dict[tuple[int, object], int] = {}
    for _ in range(n):
        best, at = -1.0, None
        for cell, m in left.items():
            if m > 0:
                score = sum(1.0 / (seen.get((i, v), 0) + 1) for i, v in enumerate(cell)) + 0.1 * rnd.random() ** (1.0 / m)
                if score > best:
                    best, at = score, cell
        if at is None:
            break
        left[at] -= 1
        taken[at] += 1
        for i, v in enumerate(at):
            seen[i, v] = seen.get((i, v), 0) + 1
    return {c: k for c, k in taken.items() if k}


def greedy(am: DataFrame, axis: str, seed: int = SEED) -> DataFrame:
    """The subjects of an axis, each label's quota spread over the values of its diversity columns."""
    label, second, key = f"{axis}_label", DIVERSITY[axis], SUBJECT[axis]
    rows = pool(am, axis)
    counts = rows.groupBy(label, *second).agg(F.count("*").alias("n")).collect()  # at most labels x labels x labels
    wanted = []
    for i, (code, n) in enumerate(QUOTAS[axis].items()):
        cells = {tuple(r[c] for c in second): r["n"] for r in counts if r[label] == code}
        wanted += [(code, *cell, k) for cell, k in choose(cells, n, Random(seed * 1000 + i)).items()]
    schema = ", ".join([f"_l string, {', '.join(f'_s{i} string' for i in range(len(second)))}, _k int"])
    picks = literal(am.sparkSession, wanted, schema)
    cond = F.col(label) == F.col("_l")
    for i, c in enumerate(second):
        cond = cond & F.col(c).eqNullSafe(F.col(f"_s{i}"))
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(label, *second).orderBy(draw(seed, key), key))).where(F.col("_n") <= max(QUOTAS[axis].values()))
    out = ranked.join(F.broadcast(picks), cond).where("_n <= _k")  # picks: at most a row a sampled item
    return out.select(key, label, *second)


def report(sample: DataFrame, axis: str) -> DataFrame:
    """n, distinct, min, max, std and largest share deviation of each column's counts in a sample."""
    cols = [f"{axis}_label", *DIVERSITY[axis]]
    values = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols)))
    counts = sample.select(values.alias("x")).groupBy("x.column", "x.value").agg(F.count("*").alias("c"))
    s = counts.groupBy("column").agg(F.sum("c").alias("n"), F.count("*").alias("distinct"), F.min("c").alias("min"), F.max("c").alias("max"), F.sum(F.col("c") * F.col("c")).alias("q"))
    n, d = F.col("n").cast("double"), F.col("distinct").cast("double")
    std = F.when(d > 1, F.sqrt((d * F.col("q") - n * n)) / d).otherwise(0.0)
    dev = F.greatest(F.abs(F.col("max") / n - 1 / d), F.abs(F.col("min") / n - 1 / d))
    return s.select("column", "n", "distinct", "min", "max", std.alias("std"), dev.alias("max_dev"))
