"""Small literal tables as local relations, which the planner can fold and broadcast by their known size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def _sql(value: object, kind: str) -> str:
    if value is None:
        return f"CAST(NULL AS {kind})"
    if isinstance(value, str):
        text = value.replace("\\", "\\\\").replace("'", "\\'")
        return f"CAST('{text}' AS {kind})" if kind != "string" else f"'{text}'"
    return f"CAST({str(value).lower() if isinstance(value, bool) else value} AS {kind})"


def literal(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Rows of a schema 'name type, ...'; no Python runs when they are read."""
    names, kinds = zip(*(c.split() for c in schema.split(",")))
    if not rows:
        return spark.createDataFrame([], schema)
    values = ", ".join(f"({', '.join(map(_sql, r, kinds))})" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(f'`{n}`' for n in names)})")
