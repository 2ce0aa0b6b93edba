"""Declared schemas of the tables and their row constraints as columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import dims

DDL = {
    "queries": "query_id string, site string, category string, question_title string, question_url string, QI_label string",
    "sources": "url_id string, source_url string, resolved_url string, host_tier string, crawl_yn string, failure_category string, clen bigint, SP_label string, SD_label string, ST_label string, crawled_at_first string",
    "citations": "cit_id bigint, query_id string, url_id string, model string, model_short string, provider string, cited_sentence string, cited_len bigint, ASF_label string, evaluation_yn string, evaluation_fail_reason string",
    "model_responses": "query_id string, model_short string, raw_response string",
    "contents": "url_id string, source_url string, source_content string",
    "shared_ids": "cit_id bigint, url_id string, source_url string",
}
TIERS = "Academic|News|Gov/Org|Forum/Q&A|Social/Blog|Commercial/Other".split("|")
FAILURES = "crawl_fail judge_unevaluable cited_too_short cited_too_few_words code_fragment table_fragment".split()


def struct(name: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[name])


@dataclass(frozen=True)
class Rule:
    """A constraint on a column; a null passes unless the rule is that it be there."""

    column: str
    kind: str
    holds: Column


def _need(*columns: str) -> list[tuple]:
    return [(c, "missing", lambda c=c: F.col(c).isNotNull()) for c in columns]


def _match(column: str, pattern: str) -> tuple:
    return column, "pattern", lambda: F.col(column).rlike(pattern)


def _one_of(column: str, values: Sequence[str]) -> tuple:
    return column, "enum", lambda: F.col(column).isin(*values)


def _least(column: str, n: int) -> tuple:
    return column, "minimum", lambda: F.col(column) >= n


def _codes(axis: str, n: int) -> list[str]:
    return [f"{axis}{i}" for i in range(1, n + 1)]


_QUERY, _SOURCE = _match("query_id", r"^Q[0-9]{5}$"), _match("url_id", r"^S[0-9]{7}$")
_MODEL = _one_of("model_short", dims.SHORT)
_RULES = {
    "queries": [*_need(*"query_id site category question_title".split()), _QUERY, _one_of("category", dims.CATEGORIES), ("question_title", "length", lambda: F.length("question_title").between(1, 300)), _one_of("QI_label", _codes("QI", 5))],
    "sources": [
        *_need(*"url_id source_url host_tier crawl_yn clen crawled_at_first".split()),
        _SOURCE,
        _one_of("host_tier", TIERS),
        _one_of("crawl_yn", "YN"),
        _least("clen", 0),
        *(_one_of(f"{a}_label", _codes(a, n)) for a, n in (("SP", 6), ("SD", 10), ("ST", 6))),
    ],
    "citations": [
        *_need(*"cit_id query_id url_id model_short provider cited_sentence cited_len".split()),
        _least("cit_id", 1),
        _QUERY,
        _SOURCE,
        _MODEL,
        _one_of("provider", dims.PROVIDERS),
        _least("cited_len", 0),
        _one_of("ASF_label", _codes("ASF", 5)),
        _one_of("evaluation_yn", "YN"),
        _one_of("evaluation_fail_reason", FAILURES),
    ],
    "model_responses": [*_need("query_id", "model_short", "raw_response"), _QUERY, _MODEL],
}


class _Lazy(dict):
    """Rules are columns, which need a session; they are made when asked for."""

    def __missing__(self, name: str) -> list[Rule]:
        return [Rule(c, kind, make()) for c, kind, make in _RULES[name]]


RULES: dict[str, list[Rule]] = _Lazy()


def violations(df: DataFrame, name: str, rules: list[Rule] | None = None) -> DataFrame:
    """df with violations array<string>, 'column: kind' for each broken rule, found in one pass.

    A column that isn't there is null; one that the schema doesn't know is 'column: unexpected'
    in every row, but for model_responses, which is open.
    """
    known = {f.name for f in struct(name)}
    rows = df
    for f in struct(name):
        if f.name not in df.columns:
            rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
    checks = [F.when(~F.coalesce(r.holds, F.lit(True)), F.lit(f"{r.column}: {r.kind}")) for r in (rules if rules is not None else RULES[name])]
    if name != "model_responses":
        checks += [F.lit(f"{c}: unexpected") for c in df.columns if c not in known]
    return df.select("*", F.lit(None).alias("_")).drop("_").withColumns({}) if not checks else rows.withColumn("violations", F.filter(F.array(*checks), lambda x: x.isNotNull())).select(*df.columns, "violations")


def require_valid(df: DataFrame, name: str) -> DataFrame:
    """df, failing at the first row that breaks a rule, with all of that row's violations in the message."""
    found = violations(df, name)
    text = F.concat(F.lit(f"{name}: "), F.array_join("violations", "; "), F.lit(" in "), F.to_json(F.struct(*df.columns)))
    bad = F.when(F.size("violations") > 0, F.raise_error(text).cast("boolean")).otherwise(F.lit(True))
    return found.where(bad).select(*df.columns)


def split_valid(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the others with their violations."""
    found = violations(df, name)
    return found.where("size(violations) = 0").drop("violations"), found.where("size(violations) > 0")
