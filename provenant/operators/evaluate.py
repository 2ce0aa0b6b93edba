"""Row-level stages between search and release: crawl state, evaluation gate, merges, ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import word_count
from ..sources.durable import durable

MIN_CHARS, MIN_WORDS = 20, 5


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def crawl_state(status: Column | str, content: Column | str) -> Column:
    """crawl_yn, failure_category, clen: only a fetch that brought a body counts."""
    size = F.coalesce(F.length(_col(content)), F.lit(0)).cast("long")
    ok = F.coalesce(_col(status) == "ok", F.lit(False))
    good = ok & (size > 0)
    why = F.when(good, F.lit(None).cast("string")).when(ok, "empty body (content length 0)").otherwise("crawl failed")
    return F.struct(F.when(good, "Y").otherwise("N").alias("crawl_yn"), why.alias("failure_category"), F.when(good, size).otherwise(0).cast("long").alias("clen"))


def evaluation_gate(crawl_yn: Column | str, sentence: Column | str) -> Column:
    """evaluation_yn, evaluation_fail_reason of a fresh citation."""
    text = F.coalesce(_col(sentence), F.lit(""))
    why = F.when(~F.coalesce(_col(crawl_yn) == "Y", F.lit(False)), "crawl_fail").when(F.length(text) < MIN_CHARS, "cited_too_short").when(word_count(text) < MIN_WORDS, "cited_too_few_words")
    return F.struct(F.when(why.isNull(), "Y").otherwise("N").alias("evaluation_yn"), why.alias("evaluation_fail_reason"))


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: that with the greatest order.  A pre-aggregated grouping, no sort of a key's rows."""
    rest = [c for c in df.columns if c != key]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(key, "_r.*")


def first_wins(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row a key: that with the least order columns."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")


def one_each(df: DataFrame, key: str) -> DataFrame:
    """One row a key, null keys left out: that with the greatest _o if df has it, else the greatest.  What a join on the key shuffles anyway."""
    if "_o" in df.columns:
        return last_wins(df, key, "_o").drop("_o")
    rest = [c for c in df.columns if c != key]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*rest)).alias("_r")).select(key, "_r.*")


def with_content(df: DataFrame, contents: DataFrame, order: str) -> DataFrame:
    """df (url_id, source_url) with content, found by url_id, else by source_url; of rows with one key the last wins.

    contents: url_id, source_url, source_content and an order column.  A row is
    filed under its url_id, or under its URL if it has none.  Where a url_id stands for
    several URLs, the rows of the one asked for come first.
    """
    key = F.coalesce(F.when(F.col("url_id") != "", F.col("url_id")), F.when(F.col("source_url") != "", F.col("source_url")))
    rows = contents.select(key.alias("k"), F.coalesce("source_url", F.lit("")).alias("u"), F.coalesce("source_content", F.lit("")).alias("content"), F.col(order).alias("_o")).where("k IS NOT NULL")
    # One shuffle, by k; a url_id stands for a few URLs at most.
    each = rows.repartition("k").groupBy("k", "u").agg(F.max_by("content", "_o").alias("content"), F.max("_o").alias("_o"))
    filed = each.groupBy("k").agg(F.max_by("content", "_o").alias("content"), F.when(F.count("*") > 1, F.collect_list(F.struct("u", "content"))).alias("each"))
    by_id, by_url = filed.toDF("_ki", "_ci", "_each"), filed.select("k", "content").toDF("_ku", "_cu")
    out = df.join(by_id, F.col("url_id") == F.col("_ki"), "left").join(by_url, F.col("source_url") == F.col("_ku"), "left")
    own = F.get(F.filter("_each", lambda e: e["u"] == F.col("source_url")), F.lit(0))["content"]
    return out.withColumn("content", F.coalesce(own, "_ci", "_cu")).drop("_ki", "_ci", "_each", "_ku", "_cu")


def keep_label(new: Column | str, old: Column | str) -> Column:
    """A new label unless it is missing or empty."""
    return F.coalesce(F.when(_col(new) != "", _col(new)), _col(old))


def merge_queries(queries: DataFrame, judged: DataFrame) -> DataFrame:
    """queries with QI_label of judged (query_id, label; repeated ones as in one_each) where there is one."""
    new = one_each(judged, "query_id").select("query_id", F.col("label").alias("_l"))
    return queries.join(new, "query_id", "left").withColumn("QI_label", keep_label("_l", "QI_label")).drop("_l").select(queries.columns)


def merge_sources(sources: DataFrame, judged: DataFrame) -> DataFrame:
    """sources with three labels of judged (url_id, SP, SD, ST; repeated ones as in one_each), for crawled ones with content."""
    new = one_each(judged, "url_id").select("url_id", *(F.col(a).alias(f"_{a}") for a in ("SP", "SD", "ST")))
    out = sources.join(new, "url_id", "left")
    able = (F.col("crawl_yn") == "Y") & (F.coalesce(F.col("content"), F.lit("")) != "") if "content" in sources.columns else F.col("crawl_yn") == "Y"
    return out.withColumns({f"{a}_label": keep_label(F.when(able, F.col(f"_{a}")), f"{a}_label") for a in ("SP", "SD", "ST")}).select(sources.columns)


def merge_citations(citations: DataFrame, sources: DataFrame, judged: DataFrame) -> DataFrame:
    """The state of each citation after judging.

    sources: url_id, content; judged: cit_id, label (null: the judge couldn't tell); of
    repeated keys one row counts, as in one_each.  Not evaluable before: stays so.  No source or no content:
    crawl_fail.  Judged with a label: evaluable.  Else: judge_unevaluable.
    """
    sources, judged = one_each(sources, "url_id"), one_each(judged, "cit_id")
    src = sources.select("url_id", F.lit(True).alias("_s"), (F.coalesce(F.col("content"), F.lit("")) != "").alias("_c"))
    out = citations.join(src, "url_id", "left").join(judged.select("cit_id", F.col("label").alias("_l")), "cit_id", "left")
    before = F.coalesce(F.col("evaluation_yn") == "Y", F.lit(False))
    usable = F.coalesce(F.col("_s") & F.col("_c"), F.lit(False))
    labelled = before & usable & F.coalesce(F.col("_l") != "", F.lit(False))
    reason = F.when(~before, F.col("evaluation_fail_reason")).when(~usable, "crawl_fail").when(labelled, F.lit(None).cast("string")).otherwise("judge_unevaluable")
    out = out.withColumns({"ASF_label": F.when(labelled, F.col("_l")).otherwise(F.col("ASF_label")), "evaluation_fail_reason": reason})
    return out.withColumn("evaluation_yn", F.when(labelled, "Y").otherwise("N")).select(citations.columns)


def canonical_urls(citations: DataFrame, redirects: DataFrame) -> DataFrame:
    """citations (url) with the canonical form of each raw URL, itself where none is known."""
    known = one_each(redirects, "raw").select(F.col("raw").alias("_raw"), F.col("canonical").alias("_canonical"))
    return citations.join(known, F.col("url") == F.col("_raw"), "left").withColumn("canonical", F.coalesce("_canonical", "url")).drop("_raw", "_canonical")


def sequence(df: DataFrame, order: Sequence[str], name: str = "cit_id", start: int = 0) -> DataFrame:
    """df with consecutive numbers from start + 1 in the given order, without a global window.

    Range-partitioned and sorted once, kept, then each partition adds the number of
    rows before it; equal rows get some order.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = durable(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = {r["_p"]: r["n"] for r in rows.groupBy("_p").agg(F.count("*").alias("n")).collect()}  # one row a partition
    before, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(p, 0)
    offset = F.element_at(F.array(*map(F.lit, before)) if before else F.array(F.lit(0)), F.col("_p") + 1)
    return rows.withColumn(name, (offset + F.col("_i") + 1 + start).cast("long")).drop("_p", "_i")


def duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*key)
    return df.withColumn("_n", F.count("*").over(w)).where("_n > 1").drop("_n")
