"""Maps the driver's tables onto citations, queries and sources, in Spark and in SQL.

citations are line items (query = order, URL = part), queries are orders, sources
are parts; labels come from their columns, so that all classes occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dims
from ..operators.literal import literal
from ..operators.master import build_master

_TYPES = {"ECONOMY": 1, "LARGE": 2, "MEDIUM": 3, "PROMO": 4, "SMALL": 5, "STANDARD": 6}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], index: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.expr(index).cast("int") + 1)


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("query_id"),
        F.col("l_partkey").alias("url_id"),
        _pick(dims.SHORT, "l_suppkey % 10").alias("model_short"),
        F.concat(F.lit("ASF"), F.floor((F.col("l_quantity") - 1) / 10) + 1).alias("ASF_label"),
        F.floor("l_extendedprice").alias("cited_len"),
        F.when(F.col("l_returnflag") == "R", "N").otherwise("Y").alias("evaluation_yn"),
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("query_id"),
        _pick([s[0] for s in dims.SITES], f"o_orderkey % {len(dims.SITES)}").alias("site"),
        _pick(dims.CATEGORIES, "o_custkey % 6").alias("category"),
        F.concat(F.lit("QI"), F.substring("o_orderpriority", 1, 1)).alias("QI_label"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.lit(None).cast("int")
    for name, i in _TYPES.items():
        kind = F.when(F.col("p_type") == name, i).otherwise(kind)
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("url_id"),
        (F.col("p_size") * 200).cast("long").alias("clen"),
        F.concat(F.lit("SP"), F.col("p_partkey") % 6 + 1).alias("SP_label"),
        F.concat(F.lit("SD"), F.col("p_size") % 10 + 1).alias("SD_label"),
        F.concat(F.lit("ST"), kind).alias("ST_label"),
        F.when(F.col("p_partkey") % 10 == 0, "N").otherwise("Y").alias("crawl_yn"),
        F.date_add(F.lit("2026-03-15").cast("date"), (F.col("p_partkey") % 40).cast("int")).cast("timestamp_ntz").alias("crawled_at_first"),
    )


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_master(queries(spark, sf_dir), sources(spark, sf_dir), citations(spark, sf_dir))


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge labels and three raters a line, each shifted by one class at its own keys; as task the axis of the line's number."""
    k = F.floor((F.col("l_quantity") - 1) / 10).cast("int")
    task = _pick("QI SP SD ST ASF".split(), "(l_linenumber - 1) % 5")
    label = lambda i: F.concat(task, (k + F.when((F.col("l_orderkey") + i) % 7 == 0, 1).otherwise(0)) % 5 + 1)
    return table(spark, sf_dir, "lineitem").select(task.alias("task"), F.concat(task, k + 1).alias("judge_label"), F.array(*(label(i) for i in range(3))).alias("human_labels"))


def rated_cells(spark: SparkSession) -> DataFrame:
    """Ten raters of each cell of both matrices: the design score, shifted by -1 to 1 and kept within 1 to 5."""
    rows = [(w, f"{r}|{c}", s, i, r) for w, m in (("IPA", dims.IPA), ("SS", dims.SS)) for i, (r, c, s) in enumerate(m)]
    cells = literal(spark, rows, "matrix string, cell string, design int, i int, row_key string")
    score = lambda a: F.greatest(F.lit(1), F.least(F.lit(5), F.col("design") + (F.col("i") * 5 + a * 7 + F.col("i") * a) % 3 - 1))
    return cells.withColumn("annotator_scores", F.array(*(score(a) for a in range(10))))


# -- the same in SQL


def _values(rows: list) -> str:
    lit = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ", ".join(f"({', '.join(map(lit, r))})" for r in rows)


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


CITATIONS_SQL = f"""SELECT l_orderkey AS query_id, l_partkey AS url_id, {_list(dims.SHORT)}[l_suppkey % 10 + 1] AS model_short,
  'ASF' || CAST(floor((l_quantity - 1) / 10) + 1 AS INTEGER) AS ASF_label, CAST(floor(l_extendedprice) AS BIGINT) AS cited_len,
  CASE WHEN l_returnflag = 'R' THEN 'N' ELSE 'Y' END AS evaluation_yn FROM lineitem"""
QUERIES_SQL = f"""SELECT o_orderkey AS query_id, {_list([s[0] for s in dims.SITES])}[o_orderkey % {len(dims.SITES)} + 1] AS site,
  {_list(dims.CATEGORIES)}[o_custkey % 6 + 1] AS category, 'QI' || substr(o_orderpriority, 1, 1) AS QI_label FROM orders"""
SOURCES_SQL = f"""SELECT p_partkey AS url_id, CAST(p_size * 200 AS BIGINT) AS clen, 'SP' || (p_partkey % 6 + 1) AS SP_label, 'SD' || (p_size % 10 + 1) AS SD_label,
  'ST' || CASE p_type {' '.join(f"WHEN '{n}' THEN {i}" for n, i in _TYPES.items())} END AS ST_label,
  CASE WHEN p_partkey % 10 = 0 THEN 'N' ELSE 'Y' END AS crawl_yn,
  CAST(DATE '2026-03-15' + CAST(p_partkey % 40 AS INTEGER) AS TIMESTAMP) AS crawled_at_first FROM part"""
MASTER_SQL = f"""models(ord, model_short, provider, display) AS (VALUES {_values([(i, m[0], m[2], m[4]) for i, m in enumerate(dims.MODELS)])}),
ipa(QI_label, SP_label, ipam_score) AS (VALUES {_values(dims.IPA)}),
ss(SD_label, ST_label, ssm_score) AS (VALUES {_values(dims.SS)}),
am AS (SELECT c.query_id, q.site, q.category, c.model_short, m.provider, c.url_id, s.clen, c.cited_len, q.QI_label, s.SP_label, c.ASF_label, s.SD_label, s.ST_label,
         ipam_score, CAST(substr(c.ASF_label, 4) AS INTEGER) AS asf_score, ssm_score, 'Y' AS crawl_yn, s.crawled_at_first
  FROM ({CITATIONS_SQL}) c JOIN ({QUERIES_SQL}) q ON c.query_id = q.query_id JOIN ({SOURCES_SQL}) s ON c.url_id = s.url_id
  JOIN models m ON c.model_short = m.model_short JOIN ipa ON ipa.QI_label = q.QI_label AND ipa.SP_label = s.SP_label
  JOIN ss ON ss.SD_label = s.SD_label AND ss.ST_label = s.ST_label
  WHERE c.evaluation_yn = 'Y' AND s.crawl_yn = 'Y')"""
EVALUATED_SQL = """e AS (SELECT *, string_split('QI SP SD ST ASF', ' ')[(l_linenumber - 1) % 5 + 1] AS task, CAST(floor((l_quantity - 1) / 10) AS INTEGER) AS k FROM lineitem),
ev AS (SELECT task, task || (k + 1) AS judge_label,
  list_transform([0, 1, 2], lambda i: task || ((k + CASE WHEN (l_orderkey + i) % 7 = 0 THEN 1 ELSE 0 END) % 5 + 1)) AS human_labels FROM e)"""
CELLS_SQL = f"""cells0(matrix, cell, design, i, row_key) AS (VALUES {_values([(w, f"{r}|{c}", s, i, r) for w, m in (("IPA", dims.IPA), ("SS", dims.SS)) for i, (r, c, s) in enumerate(m)])}),
cells AS (SELECT *, list_transform(range(0, 10), lambda a: greatest(1, least(5, design + (i * 5 + a * 7 + i * a) % 3 - 1))) AS annotator_scores FROM cells0)"""
