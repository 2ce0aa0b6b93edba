"""The search and judge stages from end to end, on pluggable effects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import extract, urls
from ..operators import dims, evaluate
from . import effects
from .durable import durable


def search(
    questions: DataFrame,
    models: list[str],
    responder: effects.Responder,
    fetcher: effects.Fetcher,
    retry: float = 2.0,
    start: int = 1,
    robots: effects.Robots | None = None,
    follow: Callable[[str], str | None] | None = None,
) -> dict[str, DataFrame]:
    """citations, sources, contents, shared_ids and model_responses of questions (query_id, question_title).

    cit_ids start with `start` and follow the order of questions and of the models asked
    for.  Responses and pages are kept before they are used, so that a lost task doesn't
    ask again.
    """
    spark = questions.sparkSession
    asked = dims.models(spark).where(F.col("model_short").isin(*models) | F.col("model").isin(*models))
    responses = durable(effects.ask_models(questions, asked, responder, base=retry))
    place = F.coalesce(*(F.when((F.col("model") == m) | (F.col("model_short") == m), i) for i, m in enumerate(models)))
    named = responses.join(F.broadcast(dims.models(spark).drop("ord", "display")), "model").withColumn("model_ord", place)  # ten rows
    order = questions.select("query_id", F.monotonically_increasing_id().alias("query_ord")).groupBy("query_id").agg(F.min("query_ord").alias("query_ord"))
    named = named.join(durable(order), "query_id")
    cited = durable(extract.extract(named.select("query_id", "query_ord", "model", "model_ord", "model_short", "provider", "provider_key", "raw_response", effects.parse_meta("meta_json").alias("meta"))))
    # A URL's place: its first citation's, by query, model and number.
    first = cited.groupBy(urls.normalise_url("url").alias("url")).agg(F.min(F.struct("query_ord", "model_ord", "ord")).alias("o"))
    ranked = evaluate.sequence(first.select("url", F.col("o.query_ord").alias("a"), F.col("o.model_ord").alias("b"), F.col("o.ord").alias("c")), ["a", "b", "c", "url"], "ord")
    fetched = durable(effects.fetch_pages(ranked.select("url", "ord"), fetcher, robots=robots, follow=follow))
    out = effects.search_stage(cited, fetched, start)
    return out | {"model_responses": named.select("query_id", "model_short", "raw_response")}


def judge(tables: dict[str, DataFrame], contents: DataFrame, judge: effects.Judge, retry: float = 2.0, concurrency: int = effects.JUDGE_CONCURRENCY, shared: DataFrame | None = None) -> dict[str, DataFrame]:
    """queries, sources and citations with labels; contents: url_id, source_url, source_content.

    Sources are told apart by url_id and URL, and so are citations in shared (cit_id, url_id, source_url).
    """
    out = {}
    if "queries" in tables:
        q = tables["queries"]
        asked = q.select("query_id", F.col("question_title").alias("question"))
        out["queries"] = evaluate.merge_queries(q, durable(effects.judge_rows(asked, "QI", judge, "query_id", {"question": "question"}, concurrency=concurrency, base=retry)).select("query_id", "label"))
    src = tables["sources"]
    stored = contents.withColumn("_o", F.monotonically_increasing_id())
    # From here to the end url_id stands for both; _id is what it was.
    full = F.concat("url_id", F.lit("\n"), F.coalesce("source_url", F.lit("")))
    known = evaluate.with_content(src, stored, "_o").withColumns({"_id": F.col("url_id"), "url_id": full})
    able = known.where((F.col("crawl_yn") == "Y") & (F.coalesce(F.col("content"), F.lit("")) != "")).select("url_id", "source_url", F.substring("content", 1, 30_000).alias("content"))
    judged = able.select("url_id").distinct()
    for axis in ("SP", "SD", "ST"):
        got = durable(effects.judge_rows(able, axis, judge, "url_id", {"url": "source_url", "content": "content"}, concurrency=concurrency, base=retry))
        judged = judged.join(evaluate.last_wins(got.select("url_id", F.col("label").alias(axis), F.lit(0).alias("_o")), "url_id", "_o").drop("_o"), "url_id", "left")
    merged = evaluate.merge_sources(known, judged)
    out["sources"] = merged.withColumn("url_id", F.col("_id")).select(src.columns)
    if "citations" in tables:
        cit = tables["citations"].withColumn("_id", F.col("url_id"))
        each = known.select(F.col("_id").alias("url_id"), "content", F.col("source_url").alias("_o"))
        if shared is not None:
            each = each.unionByName(known.join(shared.select(F.col("url_id").alias("_id")), "_id", "left_semi").select("url_id", "content", F.col("source_url").alias("_o")))
            cit = cit.join(evaluate.one_each(shared.select("cit_id", full.alias("_full")), "cit_id"), "cit_id", "left").withColumn("url_id", F.coalesce("_full", "url_id")).drop("_full")
        one = evaluate.last_wins(each, "url_id", "_o").drop("_o")
        ready = cit.where("evaluation_yn = 'Y'").join(one.where("content <> ''"), "url_id").select("cit_id", "cited_sentence", F.substring("content", 1, 30_000).alias("source_content"))
        got = durable(effects.judge_rows(ready, "ASF", judge, "cit_id", {"cited_sentence": "cited_sentence", "source_content": "source_content"}, concurrency=concurrency, base=retry))
        out["citations"] = evaluate.merge_citations(cit, one, got.select("cit_id", "label")).withColumn("url_id", F.col("_id")).select(tables["citations"].columns)
    return out
