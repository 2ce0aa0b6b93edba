"""Training-data pipeline: language, near duplicates, benchmark leaks, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each as
Parquet in the shared checkpoint folder and reads it again as the next one's docs.
All but the last return the columns of documents.

* language: documents whose language can't be told (null text, or no letter) go;
* near_duplicates: of each class of near duplicates the least doc_id stays;
* decontaminate: documents with any benchmark window go;
* pii: spans of personal data become [KIND], n_chars is recounted;
* mix: sources are repeated up to the limit by temperature, as block permutations;
  every document is read at least once. Rows are reading positions without texts.

What a stage wrote is deleted once the next stage has been written.

Defined cases: null and empty texts go in the first stage; very long texts pass every stage whole;
rows of a repeated or null doc_id are judged one by one, by their texts; exact copies are near
duplicates, and ties go to the least doc_id; extra columns of documents are passed on by all
stages but the last; an empty table gives an empty result, an empty benchmark takes nothing away.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from provenant.llm import op1_simhash, op3_pii, op4_langid, op5_decontam, op6_mixing
from provenant.llm.session import checkpoint_folder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op4_langid.keep_identified(docs, op4_langid.fit_on(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op1_simhash.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op5_decontam.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op3_pii.redact_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op6_mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("pii", pii),
    ("mix", mix),
]

#: SQL can't express the classifier and the fingerprints; tests hold stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            _delete(spark, before)
        before = f"{folder}/{name}"
    return docs


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
