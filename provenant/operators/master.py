"""The fact table of evaluable citations, and the release projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import asf_score
from ..sources.durable import estimated, tasks_for
from . import dims

#: name type of the fact table, in order
MASTER = (
    "cit_id bigint,query_id string,site string,category string,model_short string,provider string,url_id string,source_url string,cited_sentence string,clen bigint,"
    "cited_len bigint,QI_label string,SP_label string,ASF_label string,SD_label string,ST_label string,ipam_score int,asf_score int,ssm_score int,crawl_yn string"
)
MASTER_COLUMNS = [c.split()[0] for c in MASTER.split(",")]
RELEASE = {
    "queries": "query_id string,site string,category string,question_title string,question_url string,QI_label string",
    "sources": "url_id string,source_url string,host_tier string,crawl_yn string,clen bigint,SP_label string,SD_label string,ST_label string,crawled_at_first string",
    "citations": "cit_id bigint,query_id string,url_id string,model_short string,provider string,cited_sentence string,cited_len bigint,ASF_label string",
    "model_responses": "query_id string,model_short string,raw_response string",
}


def where_yes(df: DataFrame, column: str) -> DataFrame:
    """Rows whose column is Y, if there is such a column."""
    return df.where(F.col(column) == "Y") if column in df.columns else df


_MATRICES = {"ipa": dims.IPA, "ss": dims.SS}


def cells_of(matrix: DataFrame) -> list[tuple[str, str, int]]:
    """The cells of a scoring matrix read from a file (a few dozen rows; the last of a repeated pair counts, as in a file)."""
    rows = matrix.select("row_key", "col_key", "score").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("a scoring matrix has at most 10,000 cells")
    return [(*k, v) for k, v in {(r["row_key"], r["col_key"]): r["score"] for r in rows}.items()]


def score(which: str, row: str, col: str, cells: list[tuple[str, str, int]] | None = None) -> Column:
    """A matrix lookup as an expression: the labels' places in their lists index a string of digits.

    No join, so nothing is read or computed where the score isn't used, and little code
    is generated.  A pair that isn't in the matrix fails.  cells: of another matrix, as a literal map.
    """
    if cells is not None:
        pair = F.concat_ws("|", F.coalesce(row, F.lit("null")), F.coalesce(col, F.lit("null")))
        found = F.create_map(*(x for r, c, n in cells for x in (F.lit(f"{r}|{c}"), F.lit(n))))
        return F.coalesce(F.try_element_at(found, pair), F.raise_error(F.concat(F.lit(f"no {which} score: "), pair)).cast("int")).cast("int")
    cells = _MATRICES[which]
    rows, cols = [*dict.fromkeys(c[0] for c in cells)], [*dict.fromkeys(c[1] for c in cells)]
    # Labels are three characters long (but for the last), so places are four apart.
    at = [f"locate(concat('|', {label}, '|'), '|{'|'.join(names)}|')" for label, names in ((row, rows), (col, cols))]
    place = f"({at[0]} + 3) div 4 * {len(cols)} - {len(cols)} + ({at[1]} + 3) div 4"
    digit = f"substring('{''.join(str(c[2]) for c in cells)}', CAST(CASE WHEN {at[1]} > 0 THEN {place} END AS INT), 1)"
    fail = f"CAST(raise_error(concat_ws(' ', 'no {which} score:', coalesce({row}, 'null'), coalesce({col}, 'null'))) AS INT)"
    return F.expr(f"CASE WHEN {at[0]} > 0 THEN coalesce(CAST({digit} AS INT), {fail}) ELSE {fail} END")


def provider_column(model: str = "model_short") -> Column:
    """Provider of a short name, 'unknown' without one: ten literal cases."""
    cases = " ".join(f"WHEN '{m[0]}' THEN '{m[2]}'" for m in dims.MODELS)
    return F.expr(f"CASE {model} {cases} ELSE 'unknown' END")


def strict_provider(model: str = "model") -> Column:
    """Provider of a short name or full id; an unknown one fails."""
    known = {name: m[2] for m in dims.MODELS for name in m[:2]}
    cases = " ".join(f"WHEN '{name}' THEN '{p}'" for name, p in known.items())
    return F.expr(f"CASE {model} {cases} ELSE CAST(raise_error(concat('no such model: ', coalesce({model}, 'null'))) AS STRING) END")


def build_master(queries: DataFrame, sources: DataFrame, citations: DataFrame, matrices: dict[str, DataFrame] | None = None, shared: DataFrame | None = None) -> DataFrame:
    """citations joined with their queries and crawled sources, with provider and three scores.

    Only what is needed of each side is joined; columns that the inputs lack are left
    out.  matrices: 'ipa' and 'ss' as sources.io.read_matrix returns them, instead of the built-in ones.
    shared: cit_id and source_url of citations whose url_id stands for several URLs; one of them that isn't there fails.
    """
    cells = {n: cells_of(m) for n, m in (matrices or {}).items()}
    cit = where_yes(citations, "evaluation_yn").drop("provider", "crawl_yn")
    if shared is not None:
        cit = cit.join(shared.groupBy("cit_id").agg(F.max("source_url").alias("_url")), "cit_id", "left")
        sources = _with_two(sources)
    src = where_yes(sources, "crawl_yn").select("url_id", *[c for c in ("source_url", "clen", "_two") if c in sources.columns], "SP_label", "SD_label", "ST_label")
    qry = queries.select("query_id", *[c for c in ("site", "category") if c in queries.columns], "QI_label")
    cit = cit.drop(*[c for c in {*src.columns, *qry.columns} - {"url_id", "query_id"} if c in cit.columns])
    # Adaptive execution packs partitions by their compressed bytes, of which such rows have few: large tables get tasks by their size.
    # By query last, as the tables of responses group by it.
    if n := tasks_for(cit):
        if estimated(src) > cit.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold():
            cit, src = cit.repartition(n, "url_id"), src.repartition(n, "url_id")
        df = cit.join(src, "url_id").repartition(n, "query_id").join(qry.repartition(n, "query_id"), "query_id")
    else:
        df = cit.join(qry, "query_id").join(src, "url_id")
    if shared is not None:
        df = df.where(F.when(F.col("_two") & F.col("_url").isNull(), _ambiguous()).otherwise(F.col("_url").isNull() | (F.col("_url") == F.col("source_url"))))
    df = df.withColumns({"provider": provider_column(), "asf_score": asf_score("ASF_label"), "crawl_yn": F.lit("Y")})
    df = df.withColumns({"ipam_score": score("ipa", "QI_label", "SP_label", cells.get("ipa")), "ssm_score": score("ss", "SD_label", "ST_label", cells.get("ss"))})
    return df.select(*[c for c in MASTER_COLUMNS if c in df.columns])


def project(df: DataFrame, schema: str) -> DataFrame:
    """The columns of a schema in its order; missing ones are null, others go."""
    out = []
    for part in schema.split(","):
        name, kind = part.split()
        out.append((F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name))
    return df.select(*out)


def release(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Release tables of judged ones: citations keep evaluable rows only."""
    return {name: project(where_yes(df, "evaluation_yn") if name == "citations" else df, RELEASE[name]) for name, df in tables.items()}


def unique_ids(sources: DataFrame) -> DataFrame:
    """sources, or an error where one url_id stands for several URLs (7 digits: likely from some thousand URLs on).

    The check is a window over url_id, by which the join is partitioned as well.
    """
    return _with_two(sources).where(F.when(F.col("_two"), _ambiguous()).otherwise(F.lit(True))).drop("_two")


def _with_two(sources: DataFrame) -> DataFrame:
    """sources with _two: whether their url_id stands for several URLs."""
    w = Window.partitionBy("url_id")
    return sources.withColumn("_two", F.min("source_url").over(w) != F.max("source_url").over(w))


def _ambiguous() -> Column:
    return F.raise_error(F.concat(F.lit("one url_id for several URLs: "), "url_id")).cast("boolean")


def colliding_ids(sources: DataFrame) -> DataFrame:
    """url_ids of several URLs, which would multiply citations in the join."""
    return sources.groupBy("url_id").agg(F.count_distinct("source_url").alias("n_urls")).where("n_urls > 1")
