"""Statistics over small tables of counts, and F quantiles.

Every statistic reads pre-aggregated counts, so a scan of the facts is one grouping
with map-side combination; ranks, votes and bootstrap samples come from the counts.
Sums are kept as integers as long as possible.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIG = "decimal(38,0)"


def share(n: Column, total: Column) -> Column:
    """Per cent; 0 of nothing."""
    return F.when(total == 0, F.lit(0.0)).otherwise(F.lit(100.0) * n / total)


def failing(score: str, most: int = 2) -> Column:
    """1 if a score fails; a null doesn't but stays in the denominator."""
    return F.coalesce((F.col(score) <= most).cast("long"), F.lit(0).cast("long"))


def population_sd(n: Column, total: Column, squares: Column) -> Column:
    """From exact sums; the radicand is an integer."""
    return F.sqrt((n.cast(BIG) * squares.cast(BIG) - total.cast(BIG) * total.cast(BIG)).cast("double")) / n


def kruskal(counts: DataFrame, by: list[str]) -> DataFrame:
    """by, n, k, h of counts by, grp, score, c: tie-corrected Kruskal-Wallis H from a contingency table.

    NaN below two groups or if all scores are equal.  Null groups and scores are left out.
    """
    counts = counts.where("grp IS NOT NULL AND score IS NOT NULL AND c > 0")
    per = counts.groupBy(*by, "score").agg(F.sum("c").alias("t"))
    w = Window.partitionBy(*by).orderBy("score")
    # Twice the mid-rank of a score: 2 * (rows below) + rows + 1.
    per = per.withColumn("mid2", 2 * (F.sum("t").over(w) - F.col("t")) + F.col("t") + 1)
    ties = per.groupBy(*by).agg(F.sum("t").alias("n"), F.sum(F.col("t").cast("double") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    ranks = counts.join(per.select(*by, "score", "mid2"), [*by, "score"]).groupBy(*by, "grp").agg(F.sum("c").alias("ng"), F.sum((F.col("c") * F.col("mid2")).cast(BIG)).alias("r2"))
    parts = ranks.groupBy(*by).agg(F.count("*").alias("k"), F.sum(F.pow(F.col("r2").cast("double") / 2, 2) / F.col("ng")).alias("s"))
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))
    good = (F.col("k") >= 2) & (F.col("ties") < n * n * n - n)
    return parts.join(ties, by).select(*by, "n", "k", F.when(good, h).otherwise(F.lit(math.nan)).alias("h"))


def eta_squared(h: Column, k: Column, n: Column) -> Column:
    return F.when(n - k <= 0, F.lit(0.0)).when(F.isnan(h), h).otherwise(F.greatest((h - k + 1) / (n - k), F.lit(0.0)))


def kendall(pairs: DataFrame, by: list[str], key: str, x: str, y: str) -> DataFrame:
    """by, tau: tau-b over few rows a group (a self-join below the diagonal); NaN if a side is constant or below two rows."""
    b = pairs.select(*[F.col(c).alias(f"_{c}") for c in by], F.col(key).alias("_k"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    cond = F.col(key) < F.col("_k")
    for c in by:
        cond = (F.col(c) == F.col(f"_{c}")) & cond
    sx, sy = F.signum(F.col(x) - F.col("_x")), F.signum(F.col(y) - F.col("_y"))
    sums = pairs.join(b, cond).groupBy(*by).agg(F.sum(sx * sy).alias("s"), F.sum(F.abs(sx)).alias("nx"), F.sum(F.abs(sy)).alias("ny"))
    tau = F.when((F.col("nx") > 0) & (F.col("ny") > 0), F.col("s") / F.sqrt(F.col("nx") * F.col("ny"))).otherwise(F.lit(math.nan))
    return pairs.select(*by).distinct().join(sums, by, "left").select(*by, F.coalesce(tau, F.lit(math.nan)).alias("tau"))


def majority(labels: Column) -> Column:
    """The label with most votes; of several the one that comes first."""
    votes = F.transform(labels, lambda a: F.size(F.filter(labels, lambda b: a == b)))
    return F.element_at(labels, F.array_position(votes, F.array_max(votes)).cast("int"))


def kappa(cells: DataFrame, by: list[str]) -> DataFrame:
    """by, n, agreement, kappa of counts by, a, b, c; NaN if agreement by chance is certain."""
    rows = cells.groupBy(*by, F.col("a").alias("x")).agg(F.sum("c").alias("ca"))
    cols = cells.groupBy(*by, F.col("b").alias("x")).agg(F.sum("c").alias("cb"))
    chance = rows.join(cols, [*by, "x"]).groupBy(*by).agg(F.sum((F.col("ca") * F.col("cb")).cast(BIG)).alias("chance"))
    total = cells.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("same"), F.count_distinct("a").alias("classes"))
    df = total.join(chance, by, "left")
    n = F.col("n").cast("double")
    po, pe = F.col("same") / n, F.coalesce(F.col("chance"), F.lit(0)).cast("double") / (n * n)
    return df.select(*by, "n", "classes", po.alias("agreement"), F.when(pe == 1, F.lit(math.nan)).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def balanced_accuracy(cells: DataFrame, by: list[str]) -> DataFrame:
    """by, bal_acc: mean recall over the classes of a."""
    per = cells.groupBy(*by, "a").agg((F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)) / F.sum("c")).alias("recall"))
    return per.groupBy(*by).agg(F.avg("recall").alias("bal_acc"))


def _kappas(matrix: np.ndarray) -> np.ndarray:
    """Cohen's kappa of each confusion matrix (..., k, k)."""
    n = matrix.sum(axis=(-1, -2))
    po = np.trace(matrix, axis1=-2, axis2=-1) / n
    pe = (matrix.sum(axis=-1) * matrix.sum(axis=-2)).sum(axis=-1) / n**2
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(pe == 1, np.nan, (po - pe) / (1 - pe))


def bootstrap_kappa(cells: DataFrame, by: str, replicates: int = 1000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """by, lo, hi: percentile interval of kappa.

    Drawing n rows with replacement is one multinomial draw over the cells of the
    confusion matrix, so the cost doesn't depend on n.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*group["a"], *group["b"]})
        at = {x: i for i, x in enumerate(names)}
        m = np.zeros((len(names), len(names)))
        for a, b, c in zip(group["a"], group["b"], group["c"]):
            m[at[a], at[b]] += c
        rng = np.random.default_rng([seed, *str(group[by].iloc[0]).encode()])
        n = int(m.sum())
        drawn = rng.multinomial(n, (m / n).ravel(), size=replicates).reshape(replicates, *m.shape)
        lo, hi = np.quantile(_kappas(drawn.astype(float)), [alpha / 2, 1 - alpha / 2])
        return pd.DataFrame({by: [group[by].iloc[0]], "lo": [float(lo)], "hi": [float(hi)]})

    return cells.select(by, "a", "b", F.col("c").cast("double")).groupBy(by).applyInPandas(run, f"{by} string, lo double, hi double")


# -- rater reliability


def icc(ratings: DataFrame, by: list[str]) -> DataFrame:
    """by, n, k, msr, msc, mse, icc: ICC(2,k) of ratings by, cell, rater, score, which must be rectangular."""
    rows = ratings.groupBy(*by, "cell").agg(F.sum("score").cast("long").alias("s"), F.count("*").alias("kc"))
    rows = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("s") * F.col("s")).alias("rr"), F.min("kc").alias("k"), F.max("kc").alias("kmax"))
    cols = ratings.groupBy(*by, "rater").agg(F.sum("score").cast("long").alias("s")).groupBy(*by).agg(F.sum(F.col("s") * F.col("s")).alias("cc"))
    total = ratings.groupBy(*by).agg(F.sum("score").cast("long").alias("t"), F.sum(F.col("score") * F.col("score")).cast("long").alias("q"))
    df = rows.join(cols, by).join(total, by)
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    even = F.when(F.col("k") == F.col("kmax"), F.lit(True)).otherwise(F.raise_error(F.lit("cells have different numbers of ratings")).cast("boolean"))
    mean = F.col("t") * F.col("t") / (n * k)
    msr = (F.col("rr") / k - mean) / (n - 1)
    msc = (F.col("cc") / n - mean) / (k - 1)
    mse = (F.col("q") - F.col("rr") / k - F.col("cc") / n + mean) / ((n - 1) * (k - 1))
    df = df.where(even).select(*by, "n", "k", msr.alias("msr"), msc.alias("msc"), mse.alias("mse"))
    return df.withColumn("icc", F.expr("(msr - mse) / (msc / n + msr - mse / n)"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 1000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / (c if abs(c) > tiny else tiny)
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def f_quantile(p: float, d1: float, d2: float) -> float:
    """The value below which an F variable lies with probability p."""
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if beta_cdf(d1 / 2, d2 / 2, mid) < p else (lo, mid)
        if hi - lo <= 4e-16 * hi:
            break
    x = (lo + hi) / 2
    return d2 * x / (d1 * (1 - x))


def icc_interval(msr: float, msc: float, mse: float, n: int, k: int) -> tuple[float, float]:
    """95 % interval of ICC(2,k); NaN without residual variance."""
    if not mse > 0:
        return math.nan, math.nan
    d1, d2 = n - 1, (n - 1) * (k - 1)
    low, high = msr / mse / f_quantile(0.975, d1, d2), msr / mse * f_quantile(0.975, d2, d1)
    shift = (msc - mse) / mse
    return (low - 1) / (low + shift), (high - 1) / (high + shift)


def pearson(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """by, r of integer columns, from exact sums; NaN below two rows or if a side is constant."""
    big = lambda c: c.cast(BIG)
    a, b = F.col(x), F.col(y)
    s = rows.groupBy(*by).agg(F.count("*").alias("m"), F.sum(big(a)).alias("a"), F.sum(big(b)).alias("b"), F.sum(big(a * b)).alias("ab"), F.sum(big(a * a)).alias("aa"), F.sum(big(b * b)).alias("bb"))
    d = {c: F.col(c).cast("double") for c in ("m", "a", "b", "ab", "aa", "bb")}
    va, vb = d["m"] * d["aa"] - d["a"] * d["a"], d["m"] * d["bb"] - d["b"] * d["b"]
    return s.select(*by, F.when((F.col("m") > 1) & (va > 0) & (vb > 0), (d["m"] * d["ab"] - d["a"] * d["b"]) / F.sqrt(va * vb)).otherwise(F.lit(math.nan)).alias("r"))
