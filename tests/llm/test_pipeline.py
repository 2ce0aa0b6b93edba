"""The pipeline, stage by stage, against brute force on each stage's own input."""

import re

import corpus_pipeline as P
from test_simhash import brute as brute1
from test_text_ops import base_spans, brute5

from provenant.llm import op4_langid


def run_stages(spark, docs, sf_dir):
    seen = {"": docs}
    for name, stage in P.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        seen[name] = docs
    return seen


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = run_stages(spark, docs, sf_dir)
    rows = {n: {r.doc_id: r for r in d.collect()} for n, d in seen.items() if n != "mix"}
    assert [n for n, _ in P.STAGES] == ["language", "near_duplicates", "decontaminate", "pii", "mix"]
    for name in ("language", "near_duplicates", "decontaminate", "pii"):
        assert seen[name].columns == docs.columns
    assert {*rows["language"]} == {i for i, r in rows[""].items() if re.search(r"[^\W\d_]", r.text or "")}
    assert {*rows["near_duplicates"]} == {c for _, c, _, _ in brute1([(i, r.text) for i, r in rows["language"].items()])}
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert {*rows["decontaminate"]} == {b[0] for b in brute5([(i, r.text) for i, r in rows["near_duplicates"].items()], bench) if not b[5]}
    assert len(rows["decontaminate"]) < len(rows["near_duplicates"]) < len(rows["language"])
    assert {*rows["pii"]} == {*rows["decontaminate"]}
    for i, r in rows["pii"].items():
        before = rows["decontaminate"][i].text
        assert not base_spans(r.text) and r.n_chars == len(r.text)
        assert (r.text == before) == (not base_spans(before)) or "[" in r.text
    assert {r.doc_id for r in seen["mix"].select("doc_id").collect()} == {*rows["pii"]}


def test_run_equals_its_stages(spark, sf_dir):
    got = sorted(map(str, P.run(spark, sf_dir).collect()))
    want = sorted(map(str, run_stages(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)["mix"].collect()))
    assert got == want and got


def test_stages_take_odd_and_empty_tables(spark, odd, none, sf_dir):
    for docs in (odd.withColumnRenamed("n_words", "n_chars"), none):
        for name, stage in P.STAGES:
            out = stage(spark, docs, sf_dir)
            out.count()
            if name != "mix":
                assert out.columns == docs.columns


def test_language_labels_of_held_out_documents_do_not_train(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = op4_langid.fit_on(docs)
    assert model.langs == sorted({r.lang for r in docs.select("lang").distinct().collect()})
