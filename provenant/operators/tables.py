"""The result tables on citation failures.

Each takes the fact table and returns a small DataFrame of unrounded numbers with a
column `ord` where the order isn't that of another column; `sources.tsv` rounds and
formats.  Every table is one pre-aggregated pass over the columns it needs, into a
number of cells that the label sets bound (10 models, 6 categories, 5 scores an axis).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..sources.durable import durable
from . import dims
from .literal import literal
from .master import provider_column

AXES = ("asf", "ssm", "ipam")
RATES = {"FFR": "asf_score", "SFR": "ssm_score", "AFR": "ipam_score"}


def _literal(df: DataFrame, rows: list, schema: str) -> DataFrame:
    return literal(df.sparkSession, rows, schema)


def _rates(names: tuple[str, ...] = ("FFR", "SFR", "AFR")) -> list[Column]:
    return [(F.lit(100.0) * F.sum(S.failing(RATES[n])) / F.count("*")).alias(n) for n in names]


def high_stakes() -> Column:
    """Null domains are not."""
    return F.coalesce(F.col("SD_label").isin(*dims.HIGH_STAKES), F.lit(False))


def pool_composition(am: DataFrame) -> DataFrame:
    cells = am.groupBy("ST_label", "SP_label", "SD_label").agg(F.count("*").alias("c"))
    cell = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(c).alias("code")) for d, c in (("Source Type", "ST_label"), ("Source Purpose", "SP_label"), ("Source Domain", "SD_label")))))
    counts = cells.select("c", cell.alias("x")).groupBy("x.dimension", "x.code").agg(F.sum("c").alias("count"))
    counts = counts.withColumn("total", F.sum("count").over(Window.partitionBy("dimension")))
    out = dims.labels(am.sparkSession).join(counts, ["dimension", "code"], "left")
    total = F.coalesce(F.max("total").over(Window.partitionBy("dimension")), F.lit(0))
    n = F.coalesce("count", F.lit(0))
    return out.select("ord", "dimension", "label", "ymyl", n.cast("long").alias("count"), S.share(n, total).alias("pct"))


def score_counts(am: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """axis, score, c and extra columns: the three scores of every row, counted."""
    extra = extra or []
    cells = am.groupBy(*extra, *(f"{a}_score" for a in AXES)).agg(F.count("*").alias("c"))
    axis = F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(f"{a}_score").alias("score")) for a in AXES)))
    return cells.select(*extra, "c", axis.alias("x")).groupBy(*extra, "x.axis", "x.score").agg(F.sum("c").alias("c"))


def score_dist(am: DataFrame) -> DataFrame:
    counts = score_counts(am).withColumn("total", F.sum("c").over(Window.partitionBy("axis")))
    names = [(i * 5 + 5 - s, a, dims.AXIS_NAMES[a][0], s, f"{dims.SCORE_NAMES[a][5 - s]} ({s})") for i, a in enumerate(AXES) for s in (5, 4, 3, 2, 1)]
    out = _literal(am, names, "ord int, axis string, dimension string, score int, label string").join(counts, ["axis", "score"], "left")
    total = F.coalesce(F.max("total").over(Window.partitionBy("axis")), F.lit(0))
    n = F.coalesce("c", F.lit(0))
    return out.select("ord", "dimension", "label", n.cast("long").alias("count"), S.share(n, total).alias("pct"))


def kruskal_by(am: DataFrame, group: str) -> DataFrame:
    """axis, n, k, h of each score by a grouping column."""
    return S.kruskal(score_counts(am, [group]).withColumnRenamed(group, "grp"), ["axis"])


def three_axis(am: DataFrame) -> DataFrame:
    counts = durable(score_counts(am, ["model_short", "category"]))  # 900 cells, read several times
    s, c = F.col("score"), F.col("c")
    sums = counts.groupBy("axis").agg(F.sum("c").alias("n"), F.sum(c * s).alias("t"), F.sum(c * s * s).alias("q"), F.sum(F.when(s <= 2, c).otherwise(0)).alias("f"))
    out = sums.select("axis", "n", (F.col("t") / F.col("n")).alias("mean"), S.population_sd(F.col("n"), F.col("t"), F.col("q")).alias("sd"), (F.lit(100.0) * F.col("f") / F.col("n")).alias("failure_rate"))
    for name, group in (("eta2_model", "model_short"), ("eta2_category", "category")):
        per = counts.groupBy("axis", F.col(group).alias("grp"), "score").agg(F.sum("c").alias("c"))
        h = S.kruskal(per, ["axis"]).select("axis", S.eta_squared(F.col("h"), F.col("k"), F.col("n")).alias(name))
        out = out.join(h, "axis", "left")
    return out


def ymyl_ssfr(am: DataFrame) -> DataFrame:
    groups = _literal(am, [(0, "YMYL (Medical + Legal + Finance)", True), (1, "non-YMYL", False)], "ord int, group string, y boolean")
    sums = am.groupBy(high_stakes().alias("y")).agg(F.count("*").alias("n"), F.avg("ssm_score").alias("R_SS"), *_rates(("SFR",)))
    return groups.join(sums, "y", "left").select("ord", "group", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "R_SS", "SFR")


def ymyl_st(am: DataFrame) -> DataFrame:
    cells = am.groupBy("ST_label", high_stakes().alias("y")).agg(F.count("*").alias("c"))
    yes, no = F.sum(F.when(F.col("y"), F.col("c")).otherwise(0)), F.sum(F.when(F.col("y"), 0).otherwise(F.col("c")))
    per = cells.groupBy("ST_label").agg(yes.alias("cy"), no.alias("cn"))
    total = cells.agg(F.coalesce(yes, F.lit(0)).alias("ny"), F.coalesce(no, F.lit(0)).alias("nn"))  # one row
    names = _literal(am, [(i, c, n) for i, (c, n) in enumerate(dims.SOURCE_TYPES.items())], "ord int, ST_label string, source_type string")
    cy, cn = F.coalesce("cy", F.lit(0)), F.coalesce("cn", F.lit(0))
    rows = names.join(per, "ST_label", "left").join(F.broadcast(total)).select("ord", "source_type", cy.cast("long").alias("ymyl_count"), S.share(cy, F.col("ny")).alias("ymyl_pct"), cn.cast("long").alias("non_ymyl_count"), S.share(cn, F.col("nn")).alias("non_ymyl_pct"))
    return rows.unionByName(total.select(F.lit(len(dims.SOURCE_TYPES)).alias("ord"), F.lit("Total").alias("source_type"), F.col("ny").cast("long").alias("ymyl_count"), F.lit(100.0).alias("ymyl_pct"), F.col("nn").cast("long").alias("non_ymyl_count"), F.lit(100.0).alias("non_ymyl_pct")))


def display_name(model: str = "model_short") -> Column:
    """Null for a model that isn't in the registry."""
    cases = " ".join(f"WHEN '{m[0]}' THEN '{m[4]}'" for m in dims.MODELS)
    return F.expr(f"CASE {model} {cases} END")


def safr_per_model(am: DataFrame) -> DataFrame:
    """Ranks over at most as many rows as there are models."""
    g = am.where("model_short IS NOT NULL").groupBy("model_short").agg(*_rates(("FFR", "SFR")))
    ranked = g.withColumns({"FFR_rank": F.rank().over(Window.orderBy("FFR")), "SFR_rank": F.rank().over(Window.orderBy("SFR"))})
    return ranked.select("model_short", display_name().alias("model"), *("FFR_rank FFR SFR_rank SFR".split()), (F.col("FFR_rank") - F.col("SFR_rank")).alias("delta_rank"))


def source_type_by_model(am: DataFrame) -> DataFrame:
    codes = [*dims.SOURCE_TYPES]
    per = am.where("model_short IS NOT NULL").groupBy("model_short").agg(*_rates(("SFR",)), *(F.count_if(F.col("ST_label") == c).alias(c) for c in codes))
    per = per.withColumns({"SFR_rank": F.rank().over(Window.orderBy("SFR")), "typed": reduce(Column.__add__, map(F.col, codes))})
    rows = per.where("typed > 0").select("model_short", display_name().alias("model"), "SFR_rank", *((F.lit(100.0) * F.col(c) / F.col("typed")).alias(c) for c in codes))
    n = F.count("*")
    total = am.agg(*(S.share(F.count_if(F.col("ST_label") == c), n).alias(c) for c in codes))
    return rows.unionByName(total.select(F.lit(None).cast("string").alias("model_short"), F.lit("Total").alias("model"), F.lit(None).cast("int").alias("SFR_rank"), *codes))


def provider_profile(am: DataFrame) -> DataFrame:
    order = _literal(am, [*enumerate(dims.PROVIDERS)], "ord int, provider string")
    sums = am.groupBy(provider_column().alias("provider")).agg(F.count("*").alias("n"), *_rates())
    sums = sums.withColumn("total", F.sum("n").over(Window.partitionBy()))  # over a row a provider
    return order.join(sums, "provider").select("ord", "provider", "n", S.share(F.col("n"), F.col("total")).alias("share"), *RATES)


def variance(am: DataFrame) -> DataFrame:
    """Sums of squares between providers, and of models within them; shares of the two together."""
    every = score_counts(am, ["model_short"]).where("score IS NOT NULL").withColumn("provider", provider_column())
    model = every.where("provider <> 'unknown'").groupBy("axis", "provider", "model_short").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("score")).alias("t"))
    provider = model.groupBy("axis", "provider").agg(F.sum("n").alias("np"), F.sum("t").alias("tp"))
    total = every.groupBy("axis").agg((F.sum(F.col("c") * F.col("score")) / F.sum("c")).alias("mu"))
    between = provider.join(total, "axis").groupBy("axis").agg(F.sum(F.col("np") * F.pow(F.col("tp") / F.col("np") - F.col("mu"), F.lit(2))).alias("sumsq_between"))
    within = model.join(provider, ["axis", "provider"]).groupBy("axis").agg(F.sum(F.col("n") * F.pow(F.col("t") / F.col("n") - F.col("tp") / F.col("np"), F.lit(2))).alias("sumsq_within"))
    both = F.col("sumsq_between") + F.col("sumsq_within")
    return between.join(within, "axis").select("axis", "sumsq_between", S.share(F.col("sumsq_between"), both).alias("pct_between"), "sumsq_within", S.share(F.col("sumsq_within"), both).alias("pct_within"))


def paired(am: DataFrame, pairs: list[tuple[str, str, str]]) -> DataFrame:
    """Two models of each provider, and their difference."""
    wanted = [m for p in pairs for m in p[1:]]
    per = am.where(F.col("model_short").isin(*wanted)).groupBy("model_short", "query_id").agg(F.count("*").alias("c"), *(F.sum(S.failing(RATES[n])).alias(n) for n in ("FFR", "SFR")))
    per = per.groupBy("model_short").agg(F.sum("c").alias("n"), (F.sum(F.when(F.col("query_id").isNotNull(), F.col("c"))) / F.count("query_id")).alias("cit_per_q"), *((F.lit(100.0) * F.sum(n) / F.sum("c")).alias(n) for n in ("FFR", "SFR")))
    order = _literal(am, [(3 * i + j, p[0], p[1 + j]) for i, p in enumerate(pairs) for j in (0, 1)], "ord int, provider string, model_short string")
    rows = order.join(per, "model_short", "left").select("ord", "provider", "model_short", display_name().alias("model"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("cit_per_q", F.lit(0.0)).alias("cit_per_q"), "FFR", "SFR")
    last = rows.groupBy("provider").agg((F.min("ord") + 2).alias("ord"), F.concat(F.lit("Δ ("), F.min_by("model_short", "ord"), F.lit(" − "), F.max_by("model_short", "ord"), F.lit(")")).alias("model"), *((F.min_by(n, "ord") - F.max_by(n, "ord")).alias(n) for n in ("FFR", "SFR")))
    null = F.lit(None)
    return rows.drop("model_short").unionByName(last.select("ord", "provider", "model", null.cast("long").alias("n"), null.cast("double").alias("cit_per_q"), "FFR", "SFR"))


def model_size_paired(am: DataFrame) -> DataFrame:
    return paired(am, dims.SIZE_PAIRS)


def reasoning_paired(am: DataFrame) -> DataFrame:
    return paired(am, dims.REASONING_PAIRS)


def response_exposure(am: DataFrame) -> DataFrame:
    """Rates of citations, and of responses with any failing citation.

    A response is a query and a model: one grouping on both, then on the model.
    """
    fails = {n: S.failing(c) for n, c in RATES.items()}
    per = am.where(F.col("model_short").isin(*dims.SHORT)).groupBy("model_short", "query_id").agg(F.count("*").alias("c"), *(F.sum(x).alias(n) for n, x in fails.items()))
    known = F.col("query_id").isNotNull()
    responses = F.count_if(known)
    hit = lambda n: F.count_if(known & (F.col(n) > 0))
    rate = [(F.lit(100.0) * F.sum(n) / F.sum("c")).alias(n) for n in RATES]
    exposed = [(F.lit(100.0) * hit(n) / responses).alias(f"R_{n}") for n in RATES]
    any_ = F.lit(100.0) * F.count_if(known & (F.col("FFR") + F.col("SFR") + F.col("AFR") > 0)) / responses
    out = per.groupBy("model_short").agg((F.sum(F.when(known, F.col("c"))) / responses).alias("nbar"), *rate, *exposed, any_.alias("Any"))
    return out.select("model_short", display_name().alias("model"), "nbar", *[c for n in RATES for c in (n, f"R_{n}")], "Any")


def _critical(counted: DataFrame, group: str) -> DataFrame:
    """grp, variant, n, f: rows of each group, and those that fail on all axes, by variant of thresholds."""
    cells = counted.withColumnRenamed(group, "grp")
    fail = lambda i, a, s: F.coalesce((F.col("ipam_score") <= i) & (F.col("asf_score") <= a) & (F.col("ssm_score") <= s), F.lit(False))
    per = F.array(*(F.struct(F.lit(j).alias("ord"), F.lit(v).alias("variant"), F.when(fail(i, a, s), F.col("c")).otherwise(0).alias("f")) for j, (v, i, a, s) in enumerate(dims.THRESHOLDS)))
    return cells.select("grp", "c", F.explode(per).alias("x")).groupBy("grp", "x.ord", "x.variant").agg(F.sum("c").alias("n"), F.sum("x.f").alias("f"))


def threshold(am: DataFrame) -> DataFrame:
    """Citations that fail on all three axes at varied thresholds, and Kendall's tau of the rates against the baseline's."""
    names = _literal(am, [(v, i, a, s) for v, i, a, s in dims.THRESHOLDS], "variant string, IPA_le int, ASF_le int, SS_le int")
    # One pass over the facts, into a few thousand cells that everything below reads.
    counted = durable(am.groupBy("model_short", "category", *(f"{a}_score" for a in AXES)).agg(F.count("*").alias("c")))
    model = _critical(counted, "model_short")
    out = model.groupBy("ord", "variant").agg(F.sum("f").cast("long").alias("n_critvm"), (F.lit(100.0) * F.sum("f") / F.sum("n")).alias("pct"))
    for name, cells in (("tau_model", model), ("tau_cat", _critical(counted, "category"))):
        rates = cells.where("grp IS NOT NULL").select("variant", "grp", (F.col("f") / F.col("n")).alias("rate"))
        base = rates.where("variant = 'baseline'").select("grp", F.col("rate").alias("base"))
        out = out.join(S.kendall(rates.join(base, "grp"), ["variant"], "grp", "base", "rate").withColumnRenamed("tau", name), "variant", "left")
    return names.join(out, "variant").select("ord", "variant", "IPA_le", "ASF_le", "SS_le", "n_critvm", "pct", "tau_model", "tau_cat")


def with_crawl_times(am: DataFrame, sources: DataFrame) -> DataFrame:
    """The facts with crawled_at_first of their source, if it isn't there."""
    if "crawled_at_first" in am.columns:
        return am
    keys = [c for c in ("url_id", "source_url") if c in am.columns and c in sources.columns]  # a url_id may stand for several URLs
    times = sources.select(*(F.col(c).alias(f"_{c}") for c in keys), "crawled_at_first")
    return am.join(times, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys], "left").drop(*(f"_{c}" for c in keys))


CUTOFF = "2026-04-03"


def temporal(am: DataFrame, cutoff: str = CUTOFF) -> DataFrame:
    """Rates before and from a date; what can't be read as a time is in neither half, halves without rows are left out."""
    ts = F.col("crawled_at_first")
    if dict(am.dtypes)["crawled_at_first"] == "string":
        ts = F.try_to_timestamp(ts).cast("timestamp_ntz")
    cut = F.lit(cutoff).cast("timestamp_ntz")
    day = lambda c: F.date_format(c, "M/dd")
    halves = am.select(ts.cast("timestamp_ntz").alias("ts"), *RATES.values()).where("ts IS NOT NULL").groupBy((F.col("ts") >= cut).alias("late")).agg(F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"), *_rates())
    halves = halves.withColumns({"first": F.min("lo").over(Window.partitionBy()), "last": F.max("hi").over(Window.partitionBy())})  # over two rows
    label = F.when(F.col("late"), F.concat(F.lit("Second ("), day(cut), F.lit("–"), day("last"), F.lit(")"))).otherwise(F.concat(F.lit("First ("), day("first"), F.lit("–"), day(F.date_sub(cut.cast("date"), 1)), F.lit(")")))
    return halves.select(F.col("late").cast("int").alias("ord"), label.alias("half"), "n", *RATES)


#: Name, function of the facts.
TABLES: dict[str, Callable[[DataFrame], DataFrame]] = {f.__name__: f for f in (pool_composition, score_dist, three_axis, ymyl_ssfr, ymyl_st, safr_per_model, source_type_by_model, provider_profile, variance, model_size_paired, reasoning_paired, response_exposure, threshold, temporal)}
