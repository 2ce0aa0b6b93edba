"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered through their first `LENGTH` bytes only, digit by digit, most
significant first: equal groups are exactly the strings of that length that start
more than once.  `radix` does so, eight bytes a pass.

Which suffixes meet in one task is decided by a digit in front of the first: the
minimiser of the string (its least-hashed gram of `GRAM` bytes).  Equal strings
have equal minimisers, and neighbouring suffixes mostly share theirs, so they
travel as one packed run; spread by their leading bytes each suffix would have to
travel by itself, with the bytes its later digits are made of.  A count of minimisers drops
most suffixes before anything is moved, and of runs that are equal as a whole one
stands for all.  See `windows` for that; a part of more than `hot` different runs is
split further, into windows counted by a grouping.

Whole runs and windows of hot parts are compared by 128 hash bits, minimisers
by 64, strings inside parts by all their bytes.

Defined cases: a null text is empty; a text shorter than `LENGTH` bytes loses
nothing; a very long text is described in overlapping pieces; repeated rows and
rows of a repeated or null doc_id are documents of their own; each byte covered by any
repeated string goes, all copies alike; judged on the input; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import kernels as K
from .radix import equal_prefixes
from .windows import HOT, Spec, apply_marks, marked_tokens

LENGTH = 200
GRAM = 32
SPEC = Spec(LENGTH, GRAM, "bytes", False, order=equal_prefixes)


def kept_bytes(text: bytes, start: np.ndarray, end: np.ndarray) -> tuple[bytes, int, int]:
    """What is left, bytes removed, and maximal removed runs."""
    gone = K.cover(len(text), start, end)
    raw = np.frombuffer(text, np.uint8)
    return raw[~gone].tobytes(), int(gone.sum()), len(K.runs(gone)[0])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        off, raw = K.string_parts(b.column(1))
        rows = []
        for r, spans in enumerate(marked_tokens(b.column(2), LENGTH)):
            text = raw[off[r] : off[r + 1]].tobytes()
            left, removed, spans_n = kept_bytes(text, *spans) if spans else (text, 0, 0)
            rows.append((len(text), removed, spans_n, hashlib.sha256(left).hexdigest()))
        cols = list(zip(*rows)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 3 + [pa.string()]))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        off, raw = K.string_parts(b.column(1))
        out = [raw[off[r] : off[r + 1]].tobytes() if spans is None else kept_bytes(raw[off[r] : off[r + 1]].tobytes(), *spans)[0] for r, spans in enumerate(marked_tokens(b.column(2), LENGTH))]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "kept"])


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, kept binary: every row's bytes without repeated strings."""
    return apply_marks(SPEC, docs, _clean, "doc_id long, kept binary", hot)


def digest(docs: DataFrame, hot: int = HOT) -> DataFrame:
    return apply_marks(SPEC, docs, _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", hot)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
win AS (SELECT doc_id, p, md5(b[p:p + 199]) AS h FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 198)) AS p FROM t WHERE octet_length(b) >= 200)),
again AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
hit AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM win WHERE h IN (SELECT h FROM again)),
run AS (SELECT doc_id, p, sum(CASE WHEN p <= before + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM hit),
span AS (SELECT doc_id, min(p) AS a, max(p) + 199 AS z FROM run GROUP BY doc_id, k),
gone AS (SELECT doc_id, sum(z - a + 1) AS n, count(*) AS s, max(z) AS z FROM span GROUP BY doc_id),
part AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS x, a - 1 AS y FROM span UNION ALL SELECT doc_id, z + 1, NULL FROM gone),
kept AS (SELECT doc_id, string_agg(hex(b[x:coalesce(y, octet_length(b))]), '' ORDER BY x) AS left_ FROM part JOIN t USING (doc_id) WHERE x <= coalesce(y, octet_length(b)) GROUP BY doc_id)
SELECT t.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(s, 0) AS BIGINT) AS n_spans, sha256(CASE WHEN n IS NULL THEN b ELSE unhex(coalesce(left_, '')) END) AS kept_sha256
FROM t LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
