"""Readers and writers: Parquet, JSON lines, TSV, JSON; and where inputs are looked for."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators import dims
from . import schemas

JUDGED = {"queries": "queries.judged.jsonl", "sources": "sources.judged.jsonl", "citations": "citations.judged.jsonl", "model_responses": "model_responses.jsonl"}


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None, strict: bool = False) -> DataFrame:
    """JSON lines, blank ones skipped; schema: name of a declared schema.

    Malformed lines and values of a wrong type fail.  With strict, rows that break a
    rule, lack a required key or have an unknown one fail, with all reasons.
    """
    if not strict:
        reader = spark.read.option("mode", "FAILFAST")
        return (reader.schema(schemas.struct(schema)) if schema else reader).json(path)
    lines = spark.read.text(path).where(F.trim("value") != "")
    kind = schemas.struct(schema)
    keys = F.json_object_keys("value")
    known = F.array(*(F.lit(f.name) for f in kind))
    need = F.array(*(F.lit(c) for c, rule, _ in schemas._RULES[schema] if rule == "missing"))
    extra = F.array_except(keys, known) if schema != "model_responses" else F.array().cast("array<string>")
    wrong = F.concat(F.transform(F.array_except(need, keys), lambda k: F.concat(k, F.lit(": missing"))), F.transform(extra, lambda k: F.concat(k, F.lit(": unexpected"))))
    parsed = F.from_json("value", kind, {"mode": "FAILFAST"})
    bad = F.when(keys.isNull(), F.raise_error(F.concat(F.lit("no JSON object: "), F.col("value"))).cast("boolean")).when(F.size(wrong) > 0, F.raise_error(F.concat(F.lit(f"{schema}: "), F.array_join(wrong, "; "), F.lit(" in "), F.col("value"))).cast("boolean")).otherwise(F.lit(True))
    return schemas.require_valid(lines.where(bad).select(parsed.alias("r")).select("r.*"), schema)


def write_jsonl(df: DataFrame, path: str, schema: str | None = None) -> None:
    """One object a row, keys in order, nulls kept."""
    rows = schemas.require_valid(df, schema) if schema else df
    rows.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet by its suffix (or a folder of it), else JSON lines; checked against a declared schema."""
    if Path(path).suffix == ".parquet":
        df = spark.read.parquet(path)
        return schemas.require_valid(df, schema) if schema else df
    return read_jsonl(spark, path, schema, strict=schema is not None)


def exists(path: str) -> bool:
    """Whether there is such a file or folder, on whatever file system the session reaches it; without a session, on this machine."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return Path(path).exists()
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def find(folder: str, name: str) -> str:
    """The first of folder, folder/judge, folder/search that holds the file."""
    for place in (folder, f"{folder}/judge", f"{folder}/search"):
        if exists(f"{place}/{name}"):
            return f"{place}/{name}"
    raise FileNotFoundError(f"{name} is not in {folder}, nor in its judge and search folders")


def sibling(path: str, name: str = "sources.parquet") -> str | None:
    """The file beside a table, or in `parquet` beside it."""
    folder = path.rstrip("/").rpartition("/")[0] or "."
    for place in (folder, f"{folder}/parquet"):
        if exists(f"{place}/{name}"):
            return f"{place}/{name}"
    return None


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """row_key, col_key, score of a TSV with three columns, the last called score; rows without a score are skipped."""
    raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    if len(raw.columns) != 3 or raw.columns[2] != "score":
        raise ValueError(f"{path}: expected two key columns and score, found {raw.columns}")
    keys = raw.toDF("row_key", "col_key", "score")
    return keys.where(F.trim(F.coalesce("score", F.lit(""))) != "").select("row_key", "col_key", F.col("score").cast("int").alias("score"))


# -- small results to one file


def cell(value: object, digits: int | None) -> str:
    if value is None or isinstance(value, float) and math.isnan(value):
        return ""
    return f"{value:.{digits}f}" if isinstance(value, float) and digits is not None else str(value)


def write_tsv(rows: Sequence[Row | dict], path: str, columns: Sequence[str], digits: int | None = 4) -> None:
    """Result rows (a few dozen at most) as one file; floats with `digits` decimals, or as Python prints them."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text("\n".join(tsv_lines(rows, columns, digits)) + "\n", encoding="utf-8")


def tsv_lines(rows: Sequence[Row | dict], columns: Sequence[str], digits: int | None = 4) -> list[str]:
    return ["\t".join(columns), *("\t".join(cell(r[c], digits) for c in columns) for r in rows)]


def write_json(value: object, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, indent=2, ensure_ascii=False), "utf-8")


def np_round(x: float | None, digits: int) -> float | None:
    """As the column function of that name, for rows on the driver."""
    if x is None or math.isnan(x):
        return x
    scale = 10.0**digits
    scaled = x * scale
    low = math.floor(scaled)
    rest = scaled - low
    return (low + (rest > 0.5 or rest == 0.5 and low % 2 == 1)) / scale


def _rounded(digits: dict[str, int], rename: dict[str, str] | None = None) -> Callable[[Iterable[Row]], list[dict]]:
    names = rename or {}

    def run(rows: Iterable[Row]) -> list[dict]:
        return [{names.get(k, k): np_round(v, digits[k]) if k in digits else v for k, v in r.asDict().items()} for r in rows]

    return run


def _axes(rows: Iterable[Row]) -> list[dict]:
    def eta(x: float) -> str:
        size = "" if math.isnan(x) else "negligible" if x < 0.01 else "small" if x < 0.06 else "medium" if x < 0.14 else "large"
        return f"{x:.3f} ({size})"

    by = {r["axis"]: r for r in rows}
    out = []
    for a in ("asf", "ssm", "ipam"):
        if a in by:
            r, (_, name, rate) = by[a], dims.AXIS_NAMES[a]
            out.append({"dimension": name, "mean_1_5": f"{r['mean']:.2f} (±{r['sd']:.2f})", "failure_rate": f"{rate} {r['failure_rate']:.1f}%", "eta2_model": eta(r["eta2_model"]), "eta2_category": eta(r["eta2_category"])})
    return out


def _variance(rows: Iterable[Row]) -> list[dict]:
    by = {r["axis"]: r.asDict() for r in rows}
    name = {"ipam": "IPA score", "asf": "AS score", "ssm": "SS score"}
    return [{"metric": name[a], **{k: np_round(v, 1) for k, v in by[a].items() if k != "axis"}} for a in name if a in by]


def _typed(rows: Iterable[Row]) -> list[dict]:
    rows = [r.asDict() for r in rows]
    used = [c for c in dims.SOURCE_TYPES if any(r[c] for r in rows)]
    return [{"model": r["model"], "SFR_rank": "" if r["SFR_rank"] is None else r["SFR_rank"], **{dims.SOURCE_TYPES[c]: np_round(r[c], 2) for c in used}} for r in rows]


#: Table: file name, order, columns (None: of the first row), formatting.
FORMATS: dict[str, tuple[list, list[str] | None, Callable]] = {
    "pool_composition": (["ord"], "dimension label ymyl count pct".split(), _rounded({"pct": 2})),
    "score_dist": (["ord"], "dimension label count pct".split(), _rounded({"pct": 1})),
    "three_axis": (["axis"], None, _axes),
    "ymyl_ssfr": (["ord"], "group n R_SS SFR_pct".split(), _rounded({"R_SS": 3, "SFR": 1}, {"SFR": "SFR_pct"})),
    "ymyl_st": (["ord"], "source_type ymyl_count ymyl_pct non_ymyl_count non_ymyl_pct".split(), _rounded({"ymyl_pct": 2, "non_ymyl_pct": 2})),
    "safr_per_model": (["FFR_rank", "model_short"], "model FFR_rank FFR SFR_rank SFR delta_rank".split(), _rounded({"FFR": 2, "SFR": 2})),
    "source_type_by_model": (["SFR_rank", "model_short"], None, _typed),
    "provider_profile": (["ord"], "provider n share FFR SFR AFR".split(), _rounded(dict.fromkeys(("share", "FFR", "SFR", "AFR"), 1))),
    "variance": (["axis"], None, _variance),
    "model_size_paired": (["ord"], "provider model n cit_per_q FFR SFR".split(), _rounded({"cit_per_q": 1, "FFR": 2, "SFR": 2})),
    "reasoning_paired": (["ord"], "provider model n cit_per_q FFR SFR".split(), _rounded({"cit_per_q": 1, "FFR": 2, "SFR": 2})),
    "response_exposure": (["-Any", "model_short"], "model nbar FFR R_FFR SFR R_SFR AFR R_AFR Any".split(), _rounded(dict.fromkeys(("nbar", "FFR", "R_FFR", "SFR", "R_SFR", "AFR", "R_AFR", "Any"), 1))),
    "threshold": (["ord"], "variant IPA_le ASF_le SS_le n_critvm pct tau_model tau_cat".split(), _rounded({"pct": 3, "tau_model": 3, "tau_cat": 3})),
    "temporal": (["ord"], "half n FFR SFR AFR".split(), _rounded(dict.fromkeys(("FFR", "SFR", "AFR"), 1))),
}


def formatted(df: DataFrame, name: str) -> tuple[list[dict], list[str]]:
    """Rows of a result table (at most 22) in display order and format, and its columns."""
    order, columns, fmt = FORMATS[name]
    rows = df.collect()
    if order[0].startswith("-"):
        key = order[0][1:]
        rows.sort(key=lambda r: (-np_round(r[key], 1), r[order[1]]))
    else:
        rows.sort(key=lambda r: tuple((r[c] is None, r[c] if r[c] is not None else 0) for c in order))
    out = fmt(rows)
    return out, columns or [*(out[0] if out else {})]


def save_table(df: DataFrame, name: str, folder: str) -> int:
    """A result table as tab_d_<name>.tsv in its display order; rows written."""
    out, columns = formatted(df, name)
    write_tsv(out, f"{folder}/tab_d_{name}.tsv", columns)
    return len(out)
