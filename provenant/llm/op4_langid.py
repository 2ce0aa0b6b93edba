"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of 1 to 3 characters, hashed to `DIM` buckets, over the
texts of labelled documents.  At most about `TRAIN_DOCS` of them are used, taken
by a hash of their id, and of their languages the `MAX_LANGS` with most documents
(the bounds of a fitted classifier); the statistics are
added up in Spark, one partial matrix a task.  The smoothed log-probability
matrix (languages x DIM floats, at most 64 MB) is broadcast, and prediction
sums its columns for the n-grams of each whole text in NumPy.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
no labelled row at all makes everything ``und``; ties go to the language that
sorts first; rows with a null lang never train; repeated rows count each time;
a null doc_id isn't held out; very long texts are taken whole, in pieces; an empty
table gives an empty result; extra columns are ignored, or kept where rows are passed
on (lang_pred and score are replaced).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .session import lean

DIM = 1 << 16
ORDERS = (1, 2, 3)
#: Documents a model is fitted on at most, in expectation.
TRAIN_DOCS = 20_000
#: Languages a model knows at most.
MAX_LANGS = 256
ALPHA = 0.1
_LETTER = re.compile(r"[^\W\d_]")
_SPACE = np.uint32(32)


def _codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of all texts, each behind a space, runs of ASCII non-letters as one space; row of each."""
    parts = [np.frombuffer((" " + (t or "").lower()).encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    code = np.concatenate(parts) if parts else np.empty(0, np.uint32)
    row = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
    blank = (code < 97) | ((code > 122) & (code < 170))
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1] | (row[1:] != row[:-1])
    keep[:1] = True
    return np.where(blank, _SPACE, code)[keep], row[keep]


def _grams(code: np.ndarray, row: np.ndarray, step: int = K.SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket and row of every n-gram, order by order; long texts in pieces that overlap by an n-gram."""
    most = max(ORDERS)
    for i in range(0, len(code), step):
        yield from _piece_grams(code[i : i + step + most - 1], row[i : i + step + most - 1], step)


def _piece_grams(code: np.ndarray, row: np.ndarray, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of the n-grams that start before `step`."""
    h = np.zeros(len(code), np.uint32)
    with np.errstate(over="ignore"):
        for n in ORDERS:
            m = len(code) - n + 1
            if m <= 0:
                return
            h = h[:m] * np.uint32(0x01000193) + (code[n - 1 :] + np.uint32(n)) * np.uint32(0x9E3779B1)
            x = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            x ^= x >> np.uint32(13)
            same = row[:m] == row[n - 1 :]
            same[step:] = False
            yield (x & np.uint32(DIM - 1))[same], row[:m][same]


def _blocks(texts: list[str | None], limit: int = K.SLICE_BYTES // 4) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or "") <= limit):
            size += len(texts[j] or "")
            j += 1
        yield i, j
        i = j


def _count(langs: list[str]) -> Callable:
    at = {x: i for i, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), DIM), np.int64)
        for b in batches:
            texts, labels = b.column(0).to_pylist(), np.array([at[x] for x in b.column(1).to_pylist()], np.int64)
            for i, j in _blocks(texts):
                code, row = _codes(texts[i:j])
                for bucket, r in _grams(code, row):
                    cells = labels[i:j][r] * DIM + bucket
                    if total.size <= 1 << 20:
                        total += np.bincount(cells, minlength=total.size).reshape(total.shape)
                    else:  # many languages: only what occurs
                        cell, n = np.unique(cells, return_counts=True)
                        total.reshape(-1)[cell] += n
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[lang, bucket])], names=["lang", "bucket", "n"])

    return run


class Model:
    """Languages in order and their log-probabilities, buckets by languages."""

    def __init__(self, langs: list[str], log_p: np.ndarray, log_prior: np.ndarray):
        self.langs, self.log_p, self.log_prior = langs, log_p, log_prior


def fit(labelled: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """From columns doc_id, text, lang; null texts and langs are left out."""
    lean(labelled.sparkSession)
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    most = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS)
    sizes = {r["lang"]: r["n"] for r in most.collect()}
    rows = rows.where(F.col("lang").isin(*sizes))
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((DIM, 0), np.float32), np.zeros(0))
    share = min(1.0, train_docs / sum(sizes.values()))
    cut = int(share * (1 << 32))
    picked = rows if share == 1.0 else rows.where((F.xxhash64(F.lit(17), "doc_id").bitwiseAND(F.lit((1 << 32) - 1))) < cut)
    counts = picked.select("text", "lang").mapInArrow(_count(langs), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counts.toPandas()  # at most languages x DIM rows
    total = np.zeros((len(langs), DIM))
    total[table["lang"].to_numpy(), table["bucket"].to_numpy()] = table["n"].to_numpy()
    total += ALPHA
    log_p = np.log(total) - np.log(total.sum(axis=1, keepdims=True))
    prior = np.array([sizes[x] for x in langs], float)
    return Model(langs, np.ascontiguousarray(log_p.T, np.float32), np.log(prior / prior.sum()))


def predict_texts(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    names, scores = ["und"] * len(texts), np.zeros(len(texts))
    if not model.langs:
        return names, scores
    for i, j in _blocks(texts):
        code, row = _codes(texts[i:j])
        n = j - i
        total = np.zeros((n, len(model.langs)))
        for bucket, r in _grams(code, row):
            if len(bucket):
                first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
                total[r[first]] += np.add.reduceat(model.log_p.take(bucket, axis=0), first, axis=0)
        total += model.log_prior
        best = total.argmax(axis=1)
        p = np.exp(total - total.max(axis=1, keepdims=True))
        p = 1.0 / p.sum(axis=1)
        for k in range(n):
            if texts[i + k] and _LETTER.search(texts[i + k]):
                names[i + k], scores[i + k] = model.langs[best[k]], p[k]
    return names, scores


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs with lang_pred and score (replaced if there)."""
    shared = lean(docs.sparkSession).sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            names, scores = predict_texts(m, b.column(b.schema.get_field_index(text_col)).to_pylist())
            yield b.append_column("lang_pred", pa.array(names, pa.string())).append_column("score", pa.array(scores, pa.float64()))

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "lang_pred string, score double"])
    return docs.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, in their columns, whose language can be told."""
    shared = lean(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, _ = predict_texts(shared.value, b.column(b.schema.get_field_index("text")).to_pylist())
            yield b.filter(pa.array([n != "und" for n in names], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_on(docs: DataFrame) -> Model:
    return fit(docs.where(~held_out()).select("doc_id", "text", "lang"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs.select("doc_id", "text"), fit_on(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
