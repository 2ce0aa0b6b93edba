"""Removal of repeated word windows by super-k-mer partitioning.

Consecutive windows of `LENGTH` words that share a minimiser (the least-hashed
gram of `GRAM` words) travel as one packed string to the bucket of that minimiser;
there sorting counts windows exactly, and a window is marked if its words also
start in a document with a smaller doc_id.  Buckets that hold one distinct string
need no sorting, those of minimisers seen in one document never leave.  See
`windows`.  Words inside buckets are compared as such, whole strings and
minimisers by 128 and 64 hash bits.

Defined cases: a null text has no words; fewer than `LENGTH` words lose nothing;
rows that repeat a doc_id do not remove each other's words (theirs isn't
smaller); a null doc_id sorts before all others; windows are judged on the
input; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import kernels as K
from .windows import HOT, Spec, apply_marks, marked_tokens

LENGTH = 50
GRAM = 12


def kept_text(raw: np.ndarray, spans: tuple[np.ndarray, np.ndarray] | None) -> tuple[bytes, int, int]:
    """Kept words joined by one space, words, words removed."""
    start, end = K.word_spans(np.concatenate((raw, np.full(1, 32, np.uint8))), K.NOT_SPACE)
    n = len(start)
    if spans is None:
        return b" ".join(raw.tobytes().split()), n, 0
    gone = K.cover(n, *spans)
    s, e = K.runs(~gone)
    data = raw.tobytes()
    return b" ".join(b" ".join(data[start[i] : end[j - 1]].split()) for i, j in zip(s, e)), n, int(gone.sum())


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        off, raw = K.string_parts(b.column(1))
        rows = []
        for r, spans in enumerate(marked_tokens(b.column(2), LENGTH)):
            left, n, removed = kept_text(raw[off[r] : off[r + 1]], spans)
            rows.append((n, removed, hashlib.sha256(left).hexdigest()))
        cols = list(zip(*rows)) if rows else [()] * 3
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 2 + [pa.string()]))], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        off, raw = K.string_parts(b.column(1))
        out = [kept_text(raw[off[r] : off[r + 1]], spans)[0].decode() for r, spans in enumerate(marked_tokens(b.column(2), LENGTH))]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "kept"])


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, kept string: every row's words without those of earlier documents' windows."""
    return apply_marks(Spec(LENGTH, GRAM, "words", True), docs, _clean, "doc_id long, kept string", hot)


def digest(docs: DataFrame, hot: int = HOT) -> DataFrame:
    return apply_marks(Spec(LENGTH, GRAM, "words", True), docs, _digest, "doc_id long, n_words long, n_removed long, kept_sha256 string", hot)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, sha256(array_to_string(w[p:p + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM t WHERE len(w) >= 50)),
low AS (SELECT h, min(doc_id) AS least FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS q FROM win JOIN low USING (h) WHERE least < doc_id),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS q FROM t),
kept AS (SELECT e.doc_id, count(g.q) AS n_removed, string_agg(e.word, ' ' ORDER BY e.q) FILTER (g.q IS NULL) AS left_
         FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.q = g.q GROUP BY e.doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(left_, '')) AS kept_sha256
FROM t LEFT JOIN kept ON t.doc_id = kept.doc_id
"""
