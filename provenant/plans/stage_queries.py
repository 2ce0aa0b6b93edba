"""Registered queries of the stages around the fact table: files, crawl, metadata, sentences, samples."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions import rounding, urls
from ..functions import text as T
from ..operators import dims, sampling, tables, validation
from ..operators import master as M
from ..sources import effects, io, providers
from ..sources.durable import shared_folder
from . import adapter as A
from . import catalog
from .catalog import SQL, _r, _with, register


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# -- files


@register("SELECT doc_id, text, lang, source, n_chars FROM documents")
def jsonl_round_trip(spark, d):
    """JSON lines written, and read again."""
    path = _place(spark, "lines")
    io.write_jsonl(A.table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars"), path)
    return io.read_jsonl(spark, path).select("doc_id", "text", "lang", "source", "n_chars")


@register("""SELECT '{"doc_id":' || doc_id || ',"lang":' || coalesce(CAST(to_json(lang) AS VARCHAR), 'null') || ',"n_chars":' || coalesce(CAST(n_chars AS VARCHAR), 'null') || ',"source":' || coalesce(CAST(to_json(source) AS VARCHAR), 'null') || '}' AS line FROM documents""")
def jsonl_lines(spark, d):
    """The lines themselves: keys in order, nulls kept."""
    path = _place(spark, "lines")
    io.write_jsonl(A.table(spark, d, "documents").select("source", "n_chars", "lang", "doc_id"), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


_RESPONSES_SQL = "SELECT 'Q' || lpad(CAST(doc_id % 100000 AS VARCHAR), 5, '0') AS query_id, {models}[doc_id % 10 + 1] AS model_short, text AS raw_response FROM documents WHERE text IS NOT NULL".replace("{models}", A._list(dims.SHORT))


def _responses(spark: SparkSession, d: str) -> DataFrame:
    docs = A.table(spark, d, "documents").where("text IS NOT NULL")
    return docs.select(F.concat(F.lit("Q"), F.lpad((F.col("doc_id") % 100_000).cast("string"), 5, "0")).alias("query_id"), A._pick(dims.SHORT, "doc_id % 10").alias("model_short"), F.col("text").alias("raw_response"))


@register(_RESPONSES_SQL)
def jsonl_strict(spark, d):
    """JSON lines checked against a declared schema when written and when read."""
    path = _place(spark, "responses")
    io.write_jsonl(_responses(spark, d), path, "model_responses")
    return io.read_table(spark, path, "model_responses")


@register(_RESPONSES_SQL)
def parquet_strict(spark, d):
    path = _place(spark, "responses") + ".parquet"
    _responses(spark, d).write.parquet(path)
    return io.read_table(spark, path, "model_responses")


@register(f"SELECT CAST(query_id AS VARCHAR) AS query_id, site, category, CAST(NULL AS VARCHAR) AS question_title, CAST(NULL AS VARCHAR) AS question_url, QI_label FROM ({A.QUERIES_SQL})")
def export_queries(spark, d):
    return M.release({"queries": A.queries(spark, d)})["queries"]


@register(f"SELECT CAST(url_id AS VARCHAR) AS url_id, CAST(NULL AS VARCHAR) AS source_url, CAST(NULL AS VARCHAR) AS host_tier, crawl_yn, clen, SP_label, SD_label, ST_label, CAST(crawled_at_first AS VARCHAR) AS crawled_at_first FROM ({A.SOURCES_SQL})")
def export_sources(spark, d):
    return M.release({"sources": A.sources(spark, d)})["sources"]


@register(_RESPONSES_SQL)
def export_responses(spark, d):
    return M.release({"model_responses": _responses(spark, d).withColumn("extra", F.lit(1))})["model_responses"]


@register(_with("SELECT query_id, url_id, model_short, cited_len, CAST(6 - ipam_score AS INTEGER) AS ipam_score, CAST(6 - ssm_score AS INTEGER) AS ssm_score, asf_score FROM am"))
def master_from_matrix_files(spark, d):
    """The fact table with scores from matrices in files, here the built-in ones turned around."""
    given = {}
    for which in ("ipa", "ss"):
        path = _place(spark, which)
        dims.matrix(spark, which).select("row_key", "col_key", (6 - F.col("score")).alias("score")).coalesce(1).write.option("sep", "\t").option("header", True).csv(path)
        given[which] = io.read_matrix(spark, path)
    am = M.build_master(A.queries(spark, d), A.sources(spark, d), A.citations(spark, d), given)
    return am.select("query_id", "url_id", "model_short", "cited_len", "ipam_score", "ssm_score", "asf_score")


@register(_with("SELECT c.query_id, c.url_id, c.model_short, c.cited_len, c.ipam_score FROM am c"))
def master_of_unique_ids(spark, d):
    """The fact table behind a check that no url_id stands for several URLs."""
    src = M.unique_ids(A.sources(spark, d).withColumn("source_url", F.concat(F.lit("https://e.example/"), "url_id")))
    return M.build_master(A.queries(spark, d), src, A.citations(spark, d)).select("query_id", "url_id", "model_short", "cited_len", "ipam_score")


def _lines(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    rows, columns = io.formatted(df, name)
    return spark.createDataFrame([*enumerate(io.tsv_lines(rows, columns))], "line int, value string")


def _round_sql(x: str, digits: int) -> str:
    """As NumPy rounds, with the four decimals of the files."""
    return f"printf('%.4f', round_even({x} * {10**digits}, 0) / {10**digits})"


def _numbered_sql(header: list[str], body: str, order: str) -> str:
    head = "' || chr(9) || '".join(header)
    return f"SELECT CAST(0 AS INTEGER) AS line, '{head}' AS value UNION ALL SELECT CAST(row_number() OVER (ORDER BY {order}) AS INTEGER), {body}"


_TAB = " || chr(9) || "


@register(
    _numbered_sql(
        "model FFR_rank FFR SFR_rank SFR delta_rank".split(),
        _TAB.join(["model", "FFR_rank", _round_sql("FFR", 2), "SFR_rank", _round_sql("SFR", 2), "delta_rank"]) + f" FROM ({SQL['safr_per_model']})",
        "FFR_rank, model_short",
    )
)
def tsv_safr_per_model(spark, d):
    """The lines of a result file: order, columns, ranks and decimals."""
    return _lines(spark, tables.safr_per_model(A.master(spark, d)), "safr_per_model")


_EXPOSURE = "nbar FFR R_FFR SFR R_SFR AFR R_AFR Any".split()


@register(
    _numbered_sql(
        ["model", *_EXPOSURE],
        _TAB.join(["model", *(_round_sql(f'"{c}"', 1) for c in _EXPOSURE)]) + f" FROM ({SQL['response_exposure']})",
        "-round_even(\"Any\" * 10, 0), model_short",
    )
)
def tsv_response_exposure(spark, d):
    return _lines(spark, tables.response_exposure(A.master(spark, d)), "response_exposure")


@register("SELECT l_orderkey, l_linenumber, round_even(l_extendedprice * l_discount * 10, 0) / 10 AS one, round_even(l_quantity * 12.5, 0) / 100 AS two FROM lineitem")
def np_rounding(spark, d):
    """Halves to even, after scaling."""
    rows = A.table(spark, d, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", rounding.np_round(F.col("l_extendedprice") * F.col("l_discount"), 1).alias("one"), rounding.np_round(F.col("l_quantity") * 0.125, 2).alias("two"))


@register("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 45 THEN '' WHEN l_discount < 0.01 THEN 'negligible' WHEN l_discount < 0.06 THEN 'small' WHEN l_discount < 0.14 THEN 'medium' ELSE 'large' END AS size FROM lineitem")
def effect_sizes(spark, d):
    eta = F.when(F.col("l_quantity") > 45, F.lit(None)).otherwise(F.col("l_discount"))
    return A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.effect_size(eta).alias("size"))


# -- agreement tables as written


@register(f"""SELECT a.task, a.n, a.agreement AS raw_agr, a.kappa AS kappa_cons, p.kappa_pair, b.bal_acc FROM ({SQL['judge_kappa']}) a JOIN ({SQL['kappa_pair']}) p ON a.task = p.task JOIN ({SQL['balanced_accuracy']}) b ON a.task = b.task""")
def agreement_table(spark, d):
    out = validation.judge_kappa(A.evaluated(spark, d)).select("task", "n", "raw_agr", "kappa_cons", "kappa_pair", "bal_acc")
    return _r(_r(out, "kappa_pair"), "kappa_cons", "bal_acc", digits=9)


@register(f"""SELECT a.grp, a.n, a.k, a.icc, p.pearson_r, m.mad FROM ({SQL['icc_2k']}) a JOIN ({SQL['matrix_pearson']}) p ON a.grp = p.grp JOIN ({SQL['matrix_mad']}) m ON a.grp = m.grp""")
def reliability_table(spark, d):
    out = validation.matrix_validation(catalog._cells(spark)).select("grp", "n", "k", "icc", "pearson_r", "mad")
    return _r(out, "icc", "pearson_r", "mad")


# -- times


@register(SQL["temporal"].replace("AND s.crawl_yn = 'Y')", "AND s.crawl_yn = 'Y' AND c.url_id % 5 <> 0)"))
def temporal_of_strings(spark, d):
    """Crawl times as strings, of which some can't be read and count in neither half."""
    am = A.master(spark, d).join(A.sources(spark, d).select("url_id", "crawled_at_first"), "url_id")
    text = F.when(F.col("url_id") % 10 == 5, "not a time").when(F.col("url_id") % 5 != 0, F.date_format("crawled_at_first", "yyyy-MM-dd'T'HH:mm:ss"))
    return tables.temporal(am.withColumn("crawled_at_first", text)).drop("ord")


# -- URLs


_HOSTS = {
    "cs.stanford.edu": "Academic", "www.ox.ac.uk": "Academic", "www.nature.com": "Academic", "arxiv.org": "Academic", "www.nih.gov": "Academic", "cdc.gov": "Gov/Org", "www.gov.uk": "Gov/Org", "data.gov.au": "Gov/Org", "who.int": "Gov/Org",
    "example.org": "Gov/Org", "en.wikipedia.org": "Gov/Org", "de.wikipedia.com": "Forum/Q&A", "www.reddit.com": "Forum/Q&A", "medium.com": "Social/Blog", "me.github.io": "Commercial/Other", "x.com": "Commercial/Other", "m.x.com.example": "Social/Blog", "www.bbc.co.uk": "News", "www.cnn.com": "News",
    "nature.example.com": "Academic", "mynature.com": "Commercial/Other", "shop.example.com": "Commercial/Other", "educational.net": "Commercial/Other",
}


@register(f"SELECT page_id, {A._list([*_HOSTS])}[page_id % {len(_HOSTS)} + 1] AS host, {A._list([*_HOSTS.values()])}[page_id % {len(_HOSTS)} + 1] AS host_tier FROM pages")
def host_tiers(spark, d):
    """Hosts of every tier and rule, with users, ports and upper case around them."""
    name = A._pick([*_HOSTS], f"page_id % {len(_HOSTS)}")
    url = F.concat(F.when(F.col("page_id") % 3 == 0, F.lit("https://u:p@")).otherwise(F.lit("http://")), F.when(F.col("page_id") % 2 == 0, F.upper(name)).otherwise(name), F.when(F.col("page_id") % 5 == 0, F.lit(":8080")).otherwise(F.lit("")), F.lit("/a.edu?x=b.gov"))
    return A.table(spark, d, "pages").select("page_id", url.alias("u")).select("page_id", urls.host("u").alias("host"), urls.host_tier("u").alias("host_tier"))


_REDIRECT = "'https://vertexaisearch.cloud.google.com/' || CASE page_id % 3 WHEN 0 THEN 'grounding-api-redirect/' WHEN 1 THEN 'other/grounding-api-redirect/' ELSE '' END || page_id"


@register(f"SELECT page_id, u, u LIKE 'https://vertexaisearch.cloud.google.com/grounding-api-redirect/%' AS redirect FROM (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN url ELSE {_REDIRECT} END AS u FROM pages)")
def grounding_redirects(spark, d):
    pages = A.table(spark, d, "pages").select("page_id", F.expr(f"CASE WHEN page_id % 4 = 0 THEN url ELSE {_REDIRECT} END").alias("u"))
    return pages.select("page_id", "u", urls.is_grounding_redirect("u").alias("redirect"))


# -- search stage


def _found(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Two citations of every page, by its URL with and without tracking; of every fourth page nothing can be fetched."""
    pages = A.table(spark, d, "pages").where("url IS NOT NULL")
    tracked = F.concat("url", F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("utm_campaign=c"))
    each = F.explode(F.array(*(F.struct(u.alias("url"), F.lit(i).alias("ord")) for i, u in ((1, F.col("url")), (2, tracked)))))
    cited = pages.select(F.concat(F.lit("Q0000"), F.col("page_id") % 7).alias("query_id"), A._pick(dims.SHORT, "page_id % 10").alias("model_short"), F.substring("html", 1, (F.col("page_id") % 60).cast("int")).alias("cited_sentence"), each.alias("e"))
    cited = cited.select("query_id", F.concat(F.lit("full-"), "model_short").alias("model"), "model_short", F.lit("P").alias("provider"), "e.url", "cited_sentence", "e.ord")
    key = urls.normalise_url("url")
    stored = pages.where("page_id % 4 <> 0").select(key.alias("url"), "html", F.concat(F.lit("2026-04-0"), F.length(key) % 9 + 1).alias("crawled_at"))
    return effects.search_stage(cited, effects.replay_fetch(cited.select(key.alias("url")), stored), 1001)


_FETCHED_SQL = rf"""pk AS (SELECT page_id, url, html, {catalog._NORM} AS k FROM pages WHERE url IS NOT NULL),
st AS (SELECT k, max(html) AS c FROM pk WHERE page_id % 4 <> 0 GROUP BY k),
so AS (SELECT DISTINCT pk.k, substr(st.c, 1, 50000) AS c, CASE WHEN st.k IS NOT NULL THEN '2026-04-0' || (length(pk.k) % 9 + 1) END AS tm, CASE WHEN length(st.c) > 0 THEN 'Y' ELSE 'N' END AS yn FROM pk LEFT JOIN st ON pk.k = st.k)"""
_ID_SQL = "'S' || lpad(CAST(CAST('0x' || substr(sha1(k), 1, 14) AS BIGINT) % 9999999 + 1 AS VARCHAR), 7, '0')"


@register(f"WITH {_FETCHED_SQL} SELECT {_ID_SQL} AS url_id, k AS source_url, yn AS crawl_yn, CASE WHEN yn = 'Y' THEN NULL WHEN c IS NULL THEN 'crawl failed' ELSE 'empty body (content length 0)' END AS failure_category, CAST(CASE WHEN yn = 'Y' THEN length(c) ELSE 0 END AS BIGINT) AS clen, tm AS crawled_at_first FROM so")
def search_sources(spark, d):
    """Sources of a search: canonical URLs, ids, crawl state and crawl times."""
    return _found(spark, d)["sources"].drop("host_tier")


@register(
    f"""WITH {_FETCHED_SQL}, ci AS (SELECT 'Q0000' || (page_id % 7) AS query_id, {_ID_SQL} AS url_id, {A._list(dims.SHORT)}[page_id % 10 + 1] AS model_short, substr(html, 1, CAST(page_id % 60 AS INTEGER)) AS cited_sentence, o AS ord, yn
FROM (SELECT page_id, html, pk.k, yn FROM pk JOIN so ON pk.k = so.k), (SELECT unnest([1, 2]) AS o))
SELECT CAST(1000 + row_number() OVER (ORDER BY query_id, 'full-' || model_short, ord, url_id, cited_sentence) AS BIGINT) AS cit_id, query_id, url_id, model_short, cited_sentence, CAST(length(cited_sentence) AS BIGINT) AS cited_len,
CASE WHEN why IS NULL THEN 'Y' ELSE 'N' END AS evaluation_yn, why AS evaluation_fail_reason FROM (SELECT *, CASE WHEN yn <> 'Y' THEN 'crawl_fail' WHEN length(cited_sentence) < 20 THEN 'cited_too_short' WHEN len(list_filter(string_split_regex(cited_sentence, '\\s+'), lambda w: w <> '')) < 5 THEN 'cited_too_few_words' END AS why FROM ci)"""
)
def search_citations(spark, d):
    """Citations of a search, numbered from a given number in the order of query, model and marker, with the evaluation gate."""
    return _found(spark, d)["citations"].select("cit_id", "query_id", "url_id", "model_short", "cited_sentence", "cited_len", "evaluation_yn", "evaluation_fail_reason")


#: Words of a document without anything that ends a sentence.
_WORD_SQL = "'a' || regexp_replace(substr(coalesce(text, ''), {}, 30), '[^a-z ]', 'x', 'g') || 'z'"
_WORDS_SQL = f"w AS (SELECT doc_id, {_WORD_SQL.format(1)} AS a, {_WORD_SQL.format(40)} AS b FROM documents)"

def _words(spark: SparkSession, d: str) -> DataFrame:
    w = lambda i: F.concat(F.lit("a"), F.regexp_replace(F.substring(F.coalesce("text", F.lit("")), i, 30), "[^a-z ]", "x"), F.lit("z"))
    return A.table(spark, d, "documents").select("doc_id", w(1).alias("a"), w(40).alias("b"))


# -- metadata, prompts, replies


_META_SQL = r"""CASE doc_id % 5 WHEN 0 THEN '{"citations":["http://a/' || doc_id || '","http://b"]}' WHEN 1 THEN '{"citations":{"2":"http://c/' || doc_id || '"}}' WHEN 2 THEN '{"native_citations":[],"text_citations":[{"text":"t ' || doc_id || '","url":"http://d"}]}'
WHEN 3 THEN '{"grounding_chunks":[{"uri":"http://e"}],"grounding_supports":[{"grounding_chunk_indices":[0,' || doc_id || '],"text":"s"}]}' ELSE '{"native_citations":[{"cited_text":"c","text":"d","url":"http://f"}]}' END"""


@register(
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'http://a/' || doc_id END AS one, CASE doc_id % 5 WHEN 0 THEN 'http://b' WHEN 1 THEN 'http://c/' || doc_id END AS two,
CASE doc_id % 5 WHEN 2 THEN 't ' || doc_id WHEN 4 THEN 'c' END AS cited_text, CASE doc_id % 5 WHEN 2 THEN 'http://d' WHEN 4 THEN 'http://f' END AS native_url, CASE doc_id % 5 WHEN 3 THEN '0,' || doc_id END AS indices FROM documents"""
)
def response_metadata(spark, d):
    """Metadata of all shapes, read from JSON."""
    docs = A.table(spark, d, "documents").select("doc_id", effects.parse_meta(F.expr(_META_SQL)).alias("m"))
    at = lambda x, i: F.get(x, F.lit(i))
    return docs.select(
        "doc_id", F.try_element_at("m.citations", F.lit(1)).alias("one"), F.try_element_at("m.citations", F.lit(2)).alias("two"), at(F.col("m.native_citations"), 0)["cited_text"].alias("cited_text"),
        at(F.col("m.native_citations"), 0)["url"].alias("native_url"), F.array_join(at(F.col("m.grounding_supports"), 0)["chunk_indices"], ",").alias("indices"),
    )


def _recorded(spark: SparkSession, d: str) -> DataFrame:
    """A recorded reply of each provider for every document."""
    url = lambda i: F.concat(F.lit(f"https://e{i}.example/"), F.col("doc_id"))
    place = lambda u: F.struct(u.alias("url"), F.lit("t").alias("title"), F.lit(3).alias("start_index"), F.lit(9).alias("end_index"))
    a, b = F.col("a"), F.col("b")
    flat = lambda kind, u: F.struct(F.lit(kind).alias("type"), u.alias("url"), F.lit(None).cast("struct<url:string,title:string,start_index:int,end_index:int>").alias("web_citation"))
    nested = F.struct(F.lit("web").alias("type"), F.lit(None).cast("string").alias("url"), place(url(2)).alias("web_citation"))
    block = lambda text, notes: F.struct(F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), notes.alias("annotations"))).alias("content"))
    replies = {
        "openai": F.struct(F.array(block(F.concat(F.lit("  "), a, F.lit(". ")), F.array(flat("url_citation", url(1)), flat("other", url(3)))), block(F.concat(b, F.lit(" [x]("), url(1), F.lit(")\n")), F.array(flat("url_citation", url(2))))).alias("output")),
        "xai": F.struct(F.array(block(F.lit(" "), F.array(flat("x", url(1)), nested, flat("y", F.lit(""))))).alias("output"), F.concat(a, F.lit(" [x]("), url(2), F.lit(") ")).alias("output_text")),
        "perplexity": F.struct(F.array(F.struct(F.struct(F.concat(F.lit("\n"), a, F.lit(" [2]")).alias("content")).alias("message"))).alias("choices"), F.array(url(1), url(2)).alias("citations")),
        "anthropic": F.struct(F.array(F.struct(F.lit("text").alias("type"), a.alias("text"), F.array(F.struct(b.alias("cited_text"), url(1).alias("url"))).alias("citations")), F.struct(F.lit("tool").alias("type"), F.lit("no").alias("text"), F.lit(None).alias("citations")), F.struct(F.lit("text").alias("type"), b.alias("text"), F.lit(None).alias("citations"))).alias("content")),
        "google": F.struct(F.when(F.col("doc_id") % 3 > 0, a).otherwise(" ").alias("text"), F.array(F.struct(F.struct(F.array(F.struct(F.struct(url(1).alias("uri")).alias("web"))).alias("grounding_chunks"), F.array(F.struct(F.struct(b.alias("text")).alias("segment"), F.array(F.lit(0)).alias("grounding_chunk_indices"))).alias("grounding_supports")).alias("grounding_metadata"))).alias("candidates")),
    }
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("provider_key"), F.to_json(r).alias("reply")) for p, r in replies.items())))
    return _words(spark, d).select("doc_id", "a", "b", each.alias("e")).select("doc_id", "e.provider_key", "e.reply")


_SHAPED = [
    ("openai", "a || '. ' || b || ' [x](https://e1.example/' || doc_id || ')'", 1, "a || '. ' || b", 1, "true"),
    ("xai", "a || ' [x](https://e2.example/' || doc_id || ')'", 2, "a", 2, "true"),
    ("perplexity", "a || ' [2]'", 2, "a", 2, "true"),
    ("anthropic", "a || chr(10) || b", 1, "b", 1, "true"),
    ("google", "a", 1, "b", 1, "doc_id % 3 > 0"),
]


@register(f"WITH {_WORDS_SQL} " + " UNION ALL ".join(f"SELECT doc_id, '{p}' AS provider_key, {t} AS raw_response, 'https://e{u}.example/' || doc_id AS url, {s} AS cited_sentence, {o} AS ord FROM w WHERE {c}" for p, t, u, s, o, c in _SHAPED))
def provider_replies(spark, d):
    """Recorded replies of all providers, shaped and taken through extraction."""
    rows = _recorded(spark, d).select("doc_id", "provider_key", providers.shaped("provider_key", "reply").alias("s")).where("s IS NOT NULL")
    rows = rows.select("doc_id", "provider_key", F.col("s.raw_response").alias("text"), "s.raw_response", "s.meta")
    return X.extract(rows).withColumnRenamed("text", "raw_response")


_REPLY_SQL = r"""CASE doc_id % 4 WHEN 0 THEN '{"label":"ST' || (doc_id % 9) || '","reasoning":"r' || doc_id || '"}' WHEN 1 THEN '{"ST_label":"ST2"}' WHEN 2 THEN 'no JSON' ELSE '{"label":"SD1","reasoning":null}' END"""


@register("SELECT doc_id, CASE WHEN doc_id % 4 = 0 AND doc_id % 9 BETWEEN 1 AND 6 THEN 'ST' || (doc_id % 9) WHEN doc_id % 4 = 1 THEN 'ST2' END AS label, CASE WHEN doc_id % 4 = 0 THEN 'r' || doc_id END AS reasoning FROM documents")
def judge_replies(spark, d):
    """Labels of a judge's JSON replies; one that isn't of the axis is null."""
    return A.table(spark, d, "documents").select("doc_id", effects.parse_reply(F.expr(_REPLY_SQL), "ST").alias("r")).select("doc_id", "r.label", "r.reasoning")


@register("SELECT page_id, md5('<url>' || chr(10) || coalesce(url, '') || chr(10) || '</url>' || chr(10) || '<content>' || chr(10) || substr(coalesce(html, ''), 1, 30000) || chr(10) || '</content>') AS source_md5, md5('<question>' || chr(10) || coalesce(url, '') || chr(10) || '</question>') AS question_md5 FROM pages")
def judge_messages(spark, d):
    """User messages of a judge, with capped contents."""
    pages = A.table(spark, d, "pages").select("page_id", "url", F.col("html").alias("content"), F.col("url").alias("question"))
    digest = lambda c: F.md5(c.cast("binary"))
    return pages.select("page_id", digest(effects.judge_message("ST")).alias("source_md5"), digest(effects.judge_message("QI")).alias("question_md5"))


# -- sentences


#: Text and what its last two sentences are, with {a} and {b} for words.
_ENDS = [
    ("One here. {a}! {b}?", "{a}! {b}?"),
    ("One. See e.g. {a} i.e. that. Dr. {b} etc. ", "See e.g. {a} i.e. that. Dr. {b} etc."),
    ("One. Go to https://x.example/a.b?c=1!d {a}. Then http://y.example/z.html {b}", "Go to https://x.example/a.b?c=1!d {a}. Then http://y.example/z.html {b}"),
    ("One.\n\n{a}\n\n{b}", "{a} {b}"),
    ("One.\n- {a}\n- {b}", "- {a} - {b}"),
    ("One. [3] **{a}**. [12] (\"{b}\")", "{a}**. {b}"),
    ("One\n### {a}\n2. {b}", "2. {b}"),
    ("{a}", "{a}"),
    ("One. {a}.\n{b}\n ", "{a}. {b}"),
    ("Two are 1.5 {a}", "Two are 1. 5 {a}"),
]


def _cases(texts: list[str]) -> str:
    def one(t: str) -> str:
        parts = "'" + t.replace("'", "''").replace("{a}", "' || a || '").replace("{b}", "' || b || '") + "'"
        return parts.replace("\n", "' || chr(10) || '")

    return "CASE doc_id % " + str(len(texts)) + " " + " ".join(f"WHEN {i} THEN {one(t)}" for i, t in enumerate(texts)) + " END"


@register(f"WITH {_WORDS_SQL} SELECT doc_id, {_cases([y for _, y in _ENDS])} AS cited_sentence FROM w")
def sentence_rules(spark, d):
    """The last two sentences where each of the rules for their ends applies."""
    return _words(spark, d).select("doc_id", F.expr(_cases([x for x, _ in _ENDS])).alias("t")).select("doc_id", T.cited_sentence("t").alias("cited_sentence"))


def _spoken(spark: SparkSession, d: str) -> DataFrame:
    """A response of each provider, of sentences that are known."""
    url = lambda i: F.concat(F.lit(f"https://e{i}.example/"), F.col("doc_id"))
    text = {
        "openai": F.concat(F.lit("First one. See e.g. "), "a", F.lit(" at https://a.b/c.d?e=1.5 now! Then **"), "b", F.lit("** [one]("), url(1), F.lit(") More said here. [two]("), url(2), F.lit(")")),
        "xai": F.concat(F.lit("First one! "), "a", F.lit(". Dr. Who said "), "b", F.lit(" [[1]]("), url(1), F.lit(")[[2]]("), url(2), F.lit(")")),
        "perplexity": F.concat(F.lit("Intro here.\n\n- "), "a", F.lit(" one?\n- "), "b", F.lit(" two [1][2] Then. [3]\n[1] https://x.example")),
        "anthropic": F.lit("not read"),
        "google": F.lit("not read"),
    }
    meta = F.struct(
        F.array(F.struct(url(2).alias("url"), F.lit("t").alias("title"), F.lit(0).alias("start_index"), F.lit(1).alias("end_index"))).alias("annotations"),
        F.create_map(F.lit(1), url(1), F.lit(2), url(2)).alias("citations"),
        F.array(F.struct(url(3).alias("url"))).alias("search_results"),
        F.array(F.struct(F.concat(F.lit("One. "), "a", F.lit("? "), "b", F.lit(".")).alias("cited_text"), url(1).alias("url")), F.struct(F.lit("x").alias("cited_text"), F.lit(" ").alias("url"))).alias("native_citations"),
        F.array(F.struct(F.lit("t").alias("title"), url(1).alias("uri")), F.struct(F.lit("t").alias("title"), F.lit(None).cast("string").alias("uri"))).alias("grounding_chunks"),
        F.array(F.struct(F.array(F.lit(0), F.lit(1)).alias("chunk_indices"), F.concat("a", F.lit(". "), "b").alias("text")), F.struct(F.array(F.lit(-1), F.lit(0), F.lit(7)).alias("chunk_indices"), F.col("b").alias("text"))).alias("grounding_supports"),
    ).cast(X.META)
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("provider_key"), t.alias("raw_response")) for p, t in text.items())))
    return _words(spark, d).select("doc_id", meta.alias("meta"), each.alias("r")).select("doc_id", "r.provider_key", "r.raw_response", "meta")


_SEE = "'See e.g. ' || a || ' at https://a.b/c.d?e=1.5 now! Then **' || b"
_CITED = [
    # provider, number of the URL, sentence, ord; annotated URLs come first
    ("openai", 1, _SEE, 2),
    ("openai", 2, _SEE + " || '** [2] More said here.'", 1),
    ("xai", 1, "a || '. Dr. Who said ' || b", 1),
    ("xai", 2, "a || '. Dr. Who said ' || b", 2),
    ("perplexity", 1, "'- ' || b || ' two'", 1),
    ("perplexity", 2, "'- ' || b || ' two'", 2),
    ("anthropic", 1, "a || '? ' || b || '.'", 1),
    ("google", 1, "a || '. ' || b", 1),
    ("google", 1, "b", 4),
]


@register(f"WITH {_WORDS_SQL} " + " UNION ALL ".join(f"SELECT doc_id, '{p}' AS provider_key, 'https://e{u}.example/' || doc_id AS url, {s} AS cited_sentence, {o} AS ord FROM w" for p, u, s, o in _CITED))
def extract_sentences(spark, d):
    """Citations of all five providers with their sentences."""
    return X.extract(_spoken(spark, d))


_TAILS = ["", "\n[1] https://a.example/", "\n  [12]   http://b.example\n[2] https://c.example", "\n[1] see https://d.example", " [1] https://e.example", "\n[x] https://f.example"]


def _tail(i: str) -> str:
    lit = lambda t: "'" + t.replace("\n", "' || chr(10) || '") + "'"
    return f"CASE doc_id % {len(_TAILS)} " + " ".join(f"WHEN {k} THEN {lit(t)}" for k, t in enumerate(_TAILS)) + " END"


@register(f"SELECT doc_id, text || CASE WHEN doc_id % {len(_TAILS)} IN (1, 2) THEN '' ELSE {_tail('doc_id')} END AS body FROM documents")
def url_list_tails(spark, d):
    """Only a trailing list of numbered URLs goes."""
    return A.table(spark, d, "documents").select("doc_id", T.strip_url_list(F.concat("text", F.expr(_tail("doc_id")))).alias("body"))


# -- all commands


class _Answers:
    """A model that cites two pages of a question, of which the second can't be fetched."""

    def __call__(self, question: str, model: str) -> tuple[str, str]:
        n = question.split()[-1]
        return f"First this. It is said here that page {n} is so. [1][2]", json.dumps({"citations": [f"http://up.example/{n}?utm_source={model}", f"http://down.example/{n}"]})


class _Pages:
    def __call__(self, url: str) -> effects.Fetched:
        if "down" in url:
            raise OSError("down")
        return effects.Fetched("ok", f"text {url}", url)


class _Labels:
    """Labels from the number at the end of what is judged."""

    def __call__(self, axis: str, parts: dict[str, str]) -> effects.Judged:
        digits = re.findall(r"\d+", next(iter(parts.values())))
        return effects.Judged(f"{axis}{int(digits[-1]) % effects.AXES[axis] + 1}")


_RUN_MODELS = ["sonar-rp", "sonar"]
_RUN_SQL = f"""WITH p AS (SELECT page_id AS n, 'http://up.example/' || page_id AS k, row_number() OVER (ORDER BY page_id) AS r FROM pages), m(model_short, i) AS (VALUES ('sonar-rp', 0), ('sonar', 1)),
lab AS (SELECT p.*, model_short, i, 'QI' || (n % 5 + 1) AS QI_label, 'SP' || (n % 6 + 1) AS SP_label, 'SD' || (n % 10 + 1) AS SD_label, 'ST' || (n % 6 + 1) AS ST_label, 'ASF' || (n % 5 + 1) AS ASF_label FROM p, m),
ipa(QI_label, SP_label, ipam_score) AS (VALUES {A._values(dims.IPA)}), ss(SD_label, ST_label, ssm_score) AS (VALUES {A._values(dims.SS)})
SELECT CAST(499 + 4 * (r - 1) + 2 * i + 1 AS BIGINT) AS cit_id, 'Q' || lpad(CAST(n AS VARCHAR), 5, '0') AS query_id, 'law' AS site, 'Science' AS category, model_short, 'Perplexity' AS provider, {_ID_SQL} AS url_id, k AS source_url,
'First this. It is said here that page ' || n || ' is so.' AS cited_sentence, CAST(length('text ' || k) AS BIGINT) AS clen, CAST(length('First this. It is said here that page ' || n || ' is so.') AS BIGINT) AS cited_len,
QI_label, SP_label, ASF_label, SD_label, ST_label, ipam_score, CAST(substr(ASF_label, 4) AS INTEGER) AS asf_score, ssm_score, 'Y' AS crawl_yn FROM lab JOIN ipa USING (QI_label, SP_label) JOIN ss USING (SD_label, ST_label)"""


@register(_RUN_SQL)
def commands_end_to_end(spark, d):
    """search, judge, export and master from a file of questions, with answers, pages and labels that are known."""
    from .. import cli

    folder = _place(spark, "run")
    title = F.concat(F.lit("Why page "), "page_id")
    questions = A.table(spark, d, "pages").select(F.concat(F.lit("Q"), F.lpad(F.col("page_id").cast("string"), 5, "0")).alias("query_id"), F.lit("law").alias("site"), F.lit("Science").alias("category"), title.alias("question_title"), F.lit(None).cast("string").alias("question_url"), F.lit(None).cast("string").alias("QI_label"))
    # One file: the order of its lines is that of the questions.
    io.write_jsonl(questions.orderBy("query_id").coalesce(1), f"{folder}/questions.jsonl", "queries")
    cli.run_search(spark, f"{folder}/questions.jsonl", _RUN_MODELS, f"{folder}/search", _Answers(), _Pages(), 500, True, retry=0.0)
    at = f"{folder}/search"
    cli.run_judge(spark, f"{folder}/questions.jsonl", f"{at}/sources.jsonl", f"{at}/citations.jsonl", f"{at}/contents.jsonl", f"{folder}/judge", _Labels(), retry=0.0)
    cli.run_export(spark, folder, f"{folder}/parquet")
    cli.run_master(spark, f"{folder}/parquet", f"{folder}/analysis_master.parquet")
    return spark.read.parquet(f"{folder}/analysis_master.parquet")


# -- samples


@register(
    f"""WITH s AS ({SQL['asf_stratified_sample']}) SELECT layer, model_short, ASF_label, query_id, url_id, cited_len,
'ASF' || row_number() OVER (ORDER BY layer, CASE WHEN layer = 1 THEN model_short ELSE '' END, ASF_label, query_id, url_id, cited_len, model_short) AS item_id FROM s"""
)
def asf_items(spark, d):
    """The sample of verdicts with its item numbers."""
    sample = sampling.fidelity_sample(A.master(spark, d), ("query_id", "url_id", "cited_len", "model_short"))
    order = ["layer", F.when(F.col("layer") == 1, F.col("model_short")).otherwise(""), "ASF_label", "query_id", "url_id", "cited_len", "model_short"]
    return sampling.numbered(sample, "ASF", order).select("layer", "model_short", "ASF_label", "query_id", "url_id", "cited_len", "item_id")


@register(f"SELECT l_orderkey, l_linenumber, model, provider FROM (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN {A._list([m[1] for m in dims.MODELS])}[l_suppkey % 10 + 1] ELSE {A._list(dims.SHORT)}[l_suppkey % 10 + 1] END AS model, {A._list([m[2] for m in dims.MODELS])}[l_suppkey % 10 + 1] AS provider FROM lineitem)")
def model_providers(spark, d):
    """Providers of short names and full ids."""
    model = F.when(F.col("l_linenumber") % 2 == 0, A._pick([m[1] for m in dims.MODELS], "l_suppkey % 10")).otherwise(A._pick(dims.SHORT, "l_suppkey % 10"))
    return A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", model.alias("model")).withColumn("provider", M.strict_provider())


def _pool_sql(axis: str) -> str:
    key, cols = sampling.SUBJECT[axis], [f"{axis}_label", *sampling.DIVERSITY[axis]]
    cases = " ".join(f"WHEN '{k}' THEN {n}" for k, n in sampling.QUOTAS[axis].items())
    least = f"SELECT {key}, {cols[0]} AS label, row_number() OVER (PARTITION BY {key} ORDER BY {', '.join(cols)}) AS r FROM am"
    return f"SELECT '{axis}' AS axis, label, least(count(*), CASE label {cases} END) AS n FROM ({least}) WHERE r = 1 AND label IN ({', '.join(repr(k) for k in sampling.QUOTAS[axis])}) GROUP BY label"


@register(_with(" UNION ALL ".join(_pool_sql(a) for a in sampling.QUOTAS)))
def greedy_counts(spark, d):
    """Subjects of each label in the greedy samples of all axes: the quota, or as many as there are."""
    am, out = A.master(spark, d), None
    for axis in sampling.QUOTAS:
        one = sampling.greedy(am, axis).groupBy(F.lit(axis).alias("axis"), F.col(f"{axis}_label").alias("label")).agg(F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out
