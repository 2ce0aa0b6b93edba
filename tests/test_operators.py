import json
import math
import time
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from random import Random

import pytest
from pyspark.sql import functions as F

from provenant import cli
from provenant.functions import extract
from provenant.operators import dims, evaluate, sampling, tables
from provenant.operators import master as M
from provenant.plans import adapter as A
from provenant.sources import effects, io, schemas


@pytest.fixture(scope="module")
def am(spark, sf_dir):
    return A.master(spark, sf_dir).withColumn("cit_id", F.monotonically_increasing_id() + 1).cache()


@pytest.fixture(scope="module")
def facts(am):
    return am.toPandas()


def test_master_needs_every_score(spark, sf_dir):
    c, q, s = A.citations(spark, sf_dir), A.queries(spark, sf_dir), A.sources(spark, sf_dir)
    odd = s.withColumn("ST_label", F.lit("ST9"))
    with pytest.raises(Exception, match="no ss score"):
        M.build_master(q, odd, c).collect()
    plain = M.build_master(q, s.drop("crawl_yn"), c.drop("evaluation_yn", "cited_len"))
    assert "cited_len" not in plain.columns and plain.count() > M.build_master(q, s, c).count()
    assert M.colliding_ids(spark.createDataFrame([("S1", "a"), ("S1", "b"), ("S2", "c")], "url_id string, source_url string")).count() == 1


def test_tables_do_not_depend_on_partitions(am):
    for name in ("safr_per_model", "response_exposure", "threshold", "pool_composition", "three_axis"):
        key = lambda rows: sorted(str({k: round(v, 9) if isinstance(v, float) else v for k, v in r.asDict().items()}) for r in rows)
        assert key(tables.TABLES[name](am.repartition(1)).collect()) == key(tables.TABLES[name](am.repartition(7)).collect())


def test_tables_against_pandas(am, facts):
    n = len(facts)
    pool = tables.pool_composition(am).collect()
    assert len(pool) == 22 and math.isclose(sum(r.pct for r in pool), 300)
    ranks = {r.model_short: r for r in tables.safr_per_model(am).collect()}
    want = (facts.asf_score <= 2).groupby(facts.model_short).mean() * 100
    for m, r in want.rank(method="min").items():
        assert ranks[m].FFR_rank == r and math.isclose(ranks[m].FFR, want[m])
    per = facts.groupby(["model_short", "query_id"]).agg(a=("asf_score", "min"), s=("ssm_score", "min"), i=("ipam_score", "min"), n=("asf_score", "size")).reset_index()
    for r in tables.response_exposure(am).collect():
        sub = per[per.model_short == r.model_short]
        assert math.isclose(r.nbar, sub.n.mean()) and math.isclose(r.R_FFR, 100 * (sub.a <= 2).mean())
        assert math.isclose(r.Any, 100 * ((sub.a <= 2) | (sub.s <= 2) | (sub.i <= 2)).mean())
    v = {r.axis: r for r in tables.variance(am).collect()}["asf"]
    mu = facts.asf_score.mean()
    between = sum(len(g) * (g.asf_score.mean() - mu) ** 2 for _, g in facts.groupby("provider"))
    assert math.isclose(v.sumsq_between, between, rel_tol=1e-9) and math.isclose(v.pct_between + v.pct_within, 100)
    t = {r.variant: r for r in tables.threshold(am).collect()}
    assert t["baseline"].n_critvm == ((facts.ipam_score <= 2) & (facts.asf_score <= 2) & (facts.ssm_score <= 2)).sum() and math.isclose(t["baseline"].tau_model, 1)
    assert sum(r["count"] for r in tables.score_dist(am).collect()) == 3 * n


def test_nulls_stay_in_denominators(spark):
    rows = [("gpt-5", "Science", "q1", "SP1", "SD1", "ST1", 1, 1, 1), ("gpt-5", None, "q1", None, None, None, None, None, None), (None, "Science", None, "SP1", "SD4", "ST2", 5, 5, 5)]
    df = spark.createDataFrame(rows, "model_short string, category string, query_id string, SP_label string, SD_label string, ST_label string, asf_score int, ssm_score int, ipam_score int")
    assert [(r.model_short, r.FFR) for r in tables.safr_per_model(df).collect()] == [("gpt-5", 50.0)]
    assert {r.group[:4]: r.n for r in tables.ymyl_ssfr(df).collect()} == {"YMYL": 1, "non-": 2}
    assert {r.label: r["count"] for r in tables.pool_composition(df).collect()}["Official Institution"] == 1
    empty = df.limit(0)
    for name, make in tables.TABLES.items():
        if name != "temporal":
            make(empty).collect()
    assert {r["count"] for r in tables.score_dist(empty).collect()} == {0}


def test_one_group_has_no_effect_size(spark):
    rows = [("gpt-5", "Science", i % 5 + 1) for i in range(10)]
    df = spark.createDataFrame(rows, "model_short string, category string, asf_score int").withColumns({"ssm_score": F.col("asf_score"), "ipam_score": F.col("asf_score")})
    assert all(math.isnan(r.eta2_model) and math.isclose(r.sd, math.sqrt(2)) for r in tables.three_axis(df).collect())


def test_temporal_reads_strings(spark):
    rows = [("2026-04-01T10:00:00", 1), ("2026-04-03T00:00:00", 5), ("junk", 1), (None, 1)]
    df = spark.createDataFrame(rows, "crawled_at_first string, asf_score int").withColumns({"ssm_score": F.lit(3), "ipam_score": F.lit(3)})
    got = {r.half: (r.n, r.FFR) for r in tables.temporal(df).collect()}
    assert got == {"First (4/01–4/02)": (1, 100.0), "Second (4/03–4/03)": (1, 0.0)}


def test_evaluation_stages(spark):
    rows = [("ok", "body"), ("ok", ""), ("ok", None), ("failed", "x"), (None, "x")]
    df = spark.createDataFrame(rows, "status string, content string").select(evaluate.crawl_state("status", "content").alias("s")).select("s.*")
    assert [tuple(r) for r in df.collect()] == [("Y", None, 4), ("N", "empty body (content length 0)", 0), ("N", "empty body (content length 0)", 0), ("N", "crawl failed", 0), ("N", "crawl failed", 0)]
    rows = [("Y", "one two three four five"), ("Y", "short one"), ("Y", "averyverylongword andanotherone"), ("N", "one two three four five"), (None, None)]
    df = spark.createDataFrame(rows, "y string, t string").select(evaluate.evaluation_gate("y", "t").alias("g")).select("g.*")
    assert [tuple(r) for r in df.collect()] == [("Y", None), ("N", "cited_too_short"), ("N", "cited_too_few_words"), ("N", "crawl_fail"), ("N", "crawl_fail")]


def test_citations_after_judging(spark):
    cit = spark.createDataFrame([(1, "a", None, "Y", None), (2, "b", None, "Y", None), (3, "c", None, "Y", None), (4, "a", None, "Y", None), (5, "a", None, "N", "cited_too_short"), (6, "a", None, "Y", None)], "cit_id int, url_id string, ASF_label string, evaluation_yn string, evaluation_fail_reason string")
    src = spark.createDataFrame([("a", "text"), ("b", "")], "url_id string, content string")
    jud = spark.createDataFrame([(1, "ASF5"), (2, "ASF1"), (4, None), (5, "ASF5")], "cit_id int, label string")
    got = {r.cit_id: tuple(r)[2:] for r in evaluate.merge_citations(cit, src, jud).collect()}
    assert got == {1: ("ASF5", "Y", None), 2: (None, "N", "crawl_fail"), 3: (None, "N", "crawl_fail"), 4: (None, "N", "judge_unevaluable"), 5: (None, "N", "cited_too_short"), 6: (None, "N", "judge_unevaluable")}


def test_sequence_numbers_are_consecutive(spark):
    df = spark.range(0, 1000, numPartitions=5).select((F.col("id") * 7919 % 1000).alias("k"))
    got = sorted((r.cit_id, r.k) for r in evaluate.sequence(df, ["k"], start=10).collect())
    assert got == [(i + 11, i) for i in range(1000)]
    assert evaluate.sequence(df.limit(0), ["k"]).count() == 0


def test_content_by_id_then_url(spark):
    stored = spark.createDataFrame([("S1", "u1", "old", 1), ("S1", "u1", "new", 2), (None, "u2", "by url", 3), ("", "u3", None, 4), ("S4", "u5", "id only", 5)], "url_id string, source_url string, source_content string, seq int")
    rows = spark.createDataFrame([("S1", "x"), ("S9", "u2"), ("S8", "u3"), ("S7", "u5")], "url_id string, source_url string")
    assert {r.url_id: r.content for r in evaluate.with_content(rows, stored, "seq").collect()} == {"S1": "new", "S9": "by url", "S8": "", "S7": None}


def test_samples_meet_their_quotas(am):
    key = ("query_id", "url_id", "cited_len")
    a = sampling.fidelity_sample(am.repartition(3), key).collect()
    b = sampling.fidelity_sample(am.repartition(5), key).collect()
    assert sorted(map(str, a)) == sorted(map(str, b)) and len(a) == 200
    for axis in sampling.QUOTAS:
        rows = sampling.greedy(am, axis).collect()
        there = Counter(r[f"{axis}_label"] for r in sampling.pool(am, axis).collect())
        assert Counter(r[f"{axis}_label"] for r in rows) == {k: min(n, there[k]) for k, n in sampling.QUOTAS[axis].items()}
        assert len({r[sampling.SUBJECT[axis]] for r in rows}) == len(rows)
        assert sorted(map(str, sampling.greedy(am.repartition(3), axis).collect())) == sorted(map(str, rows))


def test_choice_spreads_over_rare_values():
    cells = {("a", "x"): 1000, ("a", "y"): 1, ("b", "x"): 5, ("b", "y"): 5}
    got = sampling.choose(cells, 12, Random(1))
    assert sum(got.values()) == 12 and got[("a", "y")] == 1 and got[("b", "y")] >= 3
    assert sampling.choose({("a",): 2}, 5, Random(1)) == {("a",): 2}


def test_violations(spark, tmp_path):
    good = {"query_id": "Q00001", "site": "law", "category": "Science", "question_title": "Why?", "question_url": None, "QI_label": "QI1"}
    bad = good | {"query_id": "X", "QI_label": "QI9", "question_title": "", "site": None}
    df = spark.createDataFrame([good, bad], schemas.DDL["queries"])
    got = [sorted(r.violations) for r in schemas.violations(df, "queries").collect()]
    assert got == [[], ["QI_label: enum", "query_id: pattern", "question_title: length", "site: missing"]]
    assert [d.count() for d in schemas.split_valid(df, "queries")] == [1, 1]
    assert schemas.violations(df.withColumn("more", F.lit(1)), "queries").first().violations == ["more: unexpected"]
    with pytest.raises(Exception, match="query_id: pattern"):
        schemas.require_valid(df, "queries").collect()
    p = tmp_path / "q.jsonl"
    p.write_text(json.dumps(good) + "\n\n" + json.dumps(good) + "\n")
    assert io.read_jsonl(spark, str(p), "queries", strict=True).count() == 2 == io.read_jsonl(spark, str(p), "queries").count() == io.read_jsonl(spark, str(p)).count()
    del good["site"]
    p.write_text(json.dumps(good | {"z": 1}) + "\n")
    with pytest.raises(Exception, match="site: missing; z: unexpected"):
        io.read_jsonl(spark, str(p), "queries", strict=True).collect()


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "é")], "b int, a string")
    io.write_jsonl(df, str(tmp_path / "x"))
    lines = sorted(line for f in (tmp_path / "x").glob("part*") for line in f.read_text().splitlines())
    assert lines == ['{"a":"é","b":2}', '{"a":null,"b":1}']
    m = tmp_path / "m.tsv"
    m.write_text("QI\tSP\tscore\nQI1\tSP1\t4\nQI1\tSP2\t\n")
    assert [tuple(r) for r in io.read_matrix(spark, str(m)).collect()] == [("QI1", "SP1", 4)]
    m.write_text("QI\tSP\tpoints\n")
    with pytest.raises(ValueError):
        io.read_matrix(spark, str(m))
    io.write_tsv([{"a": 1.0, "b": None, "c": 2}, {"a": math.nan, "b": "x", "c": 3}], str(tmp_path / "t.tsv"), "abc")
    assert (tmp_path / "t.tsv").read_text() == "a\tb\tc\n1.0000\t\t2\n\tx\t3\n"
    (tmp_path / "judge").mkdir()
    (tmp_path / "judge" / "f").write_text("")
    assert io.find(str(tmp_path), "f").endswith("judge/f")
    with pytest.raises(FileNotFoundError):
        io.find(str(tmp_path), "g")


def test_commands(spark, am, tmp_path, sf_dir):
    p = tmp_path / "parquet" / "master.parquet"
    src = A.sources(spark, sf_dir).withColumn("crawled_at_first", F.col("crawled_at_first").cast("string"))
    src.write.parquet(str(tmp_path / "parquet" / "sources.parquet"))
    am.write.parquet(str(p))
    rated = A.rated_cells(spark)
    for file, which, r, c in (("ipam", "IPA", "QI_label", "SP_label"), ("ssm", "SS", "SD_label", "ST_label")):
        part = rated.where(F.col("matrix") == which).select(F.split("cell", "[|]")[0].alias(r), F.split("cell", "[|]")[1].alias(c), "annotator_scores")
        part.write.parquet(str(tmp_path / "parquet" / f"{file}_human_eval.parquet"))
    ev = A.evaluated(spark, sf_dir)
    for axis in ("QI", "ASF"):
        ev.where(F.col("task") == axis).select(F.col("judge_label").alias("gpt4o_mini_label"), "human_labels").write.parquet(str(tmp_path / "parquet" / f"{axis.lower()}_human_eval.parquet"))
    out = tmp_path / "out"
    assert cli.run_tables(spark, str(p), str(out), True) == (14, 0)
    assert len(list(out.glob("tab_d_*.tsv"))) == 14 and len((out / "tab_c_validation.tsv").read_text().splitlines()) == 13 and len((out / "tab_c_judge_kappa.tsv").read_text().splitlines()) == 3
    top = (out / "tab_d_safr_per_model.tsv").read_text().splitlines()
    assert top[0].split("\t") == "model FFR_rank FFR SFR_rank SFR delta_rank".split() and [line.split("\t")[1] for line in top[1:]] == sorted((line.split("\t")[1] for line in top[1:]), key=int)
    any_ = [float(line.split("\t")[-1]) for line in (out / "tab_d_response_exposure.tsv").read_text().splitlines()[1:]]
    assert any_ == sorted(any_, reverse=True)
    cli.run_samples(spark, str(p), str(out / "s"))
    assert len((out / "s" / "asf.jsonl").read_text().splitlines()) == 200 and json.loads((out / "s" / "qi_validation.json").read_text())["n"] == 200
    am.drop("crawled_at_first").where("asf_score IS NOT NULL").withColumn("ssm_score", F.lit(None).cast("int")).write.parquet(str(tmp_path / "alone" / "m.parquet"))
    assert cli.run_tables(spark, str(tmp_path / "alone" / "m.parquet"), str(out / "alone")) == (11, 3)


def test_export(spark, tmp_path):
    q = {"query_id": "Q00001", "site": "law", "category": "Science", "question_title": "Why?", "QI_label": "QI2", "question_url": None}
    s = {"url_id": "S0000001", "source_url": "http://e", "host_tier": "News", "crawl_yn": "Y", "clen": 5, "crawled_at_first": "2026-04-01T00:00:00", "SP_label": "SP2", "SD_label": "SD1", "ST_label": "ST1", "failure_category": None}
    c = {"cit_id": 1, "query_id": "Q00001", "url_id": "S0000001", "model_short": "sonar", "provider": "Perplexity", "cited_sentence": "x", "cited_len": 1, "ASF_label": "ASF5", "evaluation_yn": "Y", "evaluation_fail_reason": None}
    r = {"query_id": "Q00001", "model_short": "sonar", "raw_response": "t", "extra": 1}
    (tmp_path / "judge").mkdir()
    (tmp_path / "search").mkdir()
    for name, rows in (("judge/queries.judged", [q]), ("judge/sources.judged", [s]), ("judge/citations.judged", [c, c | {"cit_id": 2, "evaluation_yn": "N", "evaluation_fail_reason": "crawl_fail"}]), ("search/model_responses", [r])):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(map(json.dumps, rows)))
    paths = cli.run_export(spark, str(tmp_path), str(tmp_path / "out"))
    got = spark.read.parquet(paths["citations"])
    assert got.count() == 1 and got.columns == [x.split()[0] for x in M.RELEASE["citations"].split(",")]
    cli.run_master(spark, str(tmp_path / "out"), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).columns == M.MASTER_COLUMNS
    assert tuple(spark.read.parquet(str(tmp_path / "m")).select("ipam_score", "asf_score", "ssm_score", "provider").first()) == (5, 5, 5, "Perplexity")


def test_effects(spark):
    waits = []
    calls = iter([ValueError("HTTP 429"), ValueError("x"), 7])

    def call():
        v = next(calls)
        if isinstance(v, Exception):
            raise v
        return v

    assert effects.with_retry(call, sleep=waits.append) == 7 and waits == [60.0, 4.0]
    failing = lambda axis, parts: 1 / 0
    assert effects.judge_with_retry(failing, "QI", {}, sleep=waits.append).label is None
    judge = effects.ReplayJudge({("QI", "Why?"): "QI2", ("QI", "How?"): "QI7"})
    assert [effects.judge_with_retry(judge, "QI", {"question": q}).label for q in ("Why?", "How?", "?")] == ["QI2", None, None]
    rows = spark.createDataFrame([(1, "Why?"), (2, "How?")], "id int, t string")
    assert {r.id: r.label for r in effects.judge_rows(rows, "QI", judge, "id", {"question": "t"}).collect()} == {1: "QI2", 2: None}
    read = []
    robots = effects.Robots(lambda u: read.append(u) or ("User-agent: *\nDisallow: /no" if "a.b" in u else None))
    assert [robots.allowed(u) for u in ("http://a.b/yes", "http://a.b/no/x", "http://c.d/no")] == [True, False, True] and len(read) == 2
    slow = []
    shared = effects.Robots(lambda u: slow.append(u) or time.sleep(0.05) or "User-agent: *\nDisallow: /no")
    with ThreadPoolExecutor(8) as pool:
        assert [*pool.map(shared.allowed, ["http://e.f/no", "http://E.f/yes"] * 8)] == [False, True] * 8
    assert len(slow) == 1
    found = spark.createDataFrame([("http://a/1",), ("http://a/1",), ("http://b/2",), (None,)], "url string")

    def fetcher(url):
        if "b" in url:
            raise OSError
        return effects.Fetched("ok", "x" * 10, "http://a/final?utm_x=1")

    got = {r.url: (r.status, r.content, r.final_url) for r in effects.fetch_pages(found, fetcher, cap=4).collect()}
    assert got == {"http://a/1": ("ok", "xxxx", "http://a/final?utm_x=1"), "http://b/2": ("failed", None, "http://b/2")}
    gated = effects.fetch_pages(found.where("url IS NOT NULL"), fetcher, robots=effects.Robots(lambda u: "User-agent: *\nDisallow: /" if "//a" in u else None))
    assert {r.url: r.status for r in gated.collect()} == {"http://a/1": "blocked_by_robots", "http://b/2": "failed"}

    def late(url):
        time.sleep(1.0 if "slow" in url else 0.0)
        return effects.Fetched("ok", "x")

    class Browser:
        opened = 0

        def __enter__(self):
            Browser.opened += 1
            return lambda url: effects.Fetched("ok", str(Browser.opened))

        def __exit__(self, *_):
            Browser.opened = -1

    one = effects.fetch_pages(found.where("url IS NOT NULL").coalesce(1), Browser(), host_tasks=1).collect()
    assert {r.content for r in one} <= {"1", "0"} and {r.status for r in one} == {"ok"}
    many = spark.createDataFrame([(f"http://a/{i}", 9 - i) for i in range(9)] + [("http://a/slow", 0), ("http://a/0", 20)], "url string, ord int").repartition(1)
    rows = effects.fetch_pages(many, late, concurrency=2, timeout_ms=200, host_tasks=1).collect()
    assert [r.url for r in rows] == ["http://a/slow", *(f"http://a/{i}" for i in range(8, -1, -1))] and [r.ord for r in rows] == [0, *range(1, 10)]
    assert [r.status for r in rows] == ["failed"] + ["ok"] * 9 and all(r.crawled_at[:2] == "20" for r in rows)
    asked = effects.ask_models(spark.createDataFrame([("Q00001", "Why?")], "query_id string, question_title string"), dims.models(spark).limit(3), lambda q, m: (f"{q} {m}", "{}"))
    assert asked.count() == 3


def test_search_stage(spark):
    long = "one two three four five six"
    cited = spark.createDataFrame(
        [("Q00001", "sonar", "sonar", "Perplexity", "http://a/1?utm_x=2", long, 1), ("Q00001", "sonar", "sonar", "Perplexity", "http://a/2", "short", 2), ("Q00002", "sonar", "sonar", "Perplexity", "http://b/3", long, 1)],
        "query_id string, model string, model_short string, provider string, url string, cited_sentence string, ord int",
    )
    fetched = spark.createDataFrame([("http://a/1", "ok", "body", "http://a/one"), ("http://a/2", "ok", "other", "http://a/one"), ("http://b/3", "failed", None, "http://b/3")], "url string, status string, content string, final_url string")
    out = effects.search_stage(cited, fetched)
    got = [tuple(r) for r in out["citations"].orderBy("cit_id").select("cit_id", "query_id", "evaluation_yn", "evaluation_fail_reason").collect()]
    assert got == [(1, "Q00001", "Y", None), (2, "Q00001", "N", "cited_too_short"), (3, "Q00002", "N", "crawl_fail")]
    assert out["sources"].count() == 2 and [r.source_content for r in out["contents"].collect()] == ["body"]
    assert out["citations"].select("url_id").distinct().count() == 2
    ranked = cited.withColumn("query_ord", F.when(F.col("query_id") == "Q00002", 1).otherwise(2)).withColumn("model_ord", F.lit(0))
    timed = fetched.withColumn("ord", F.when(F.col("url") == "http://a/2", 1).otherwise(2)).withColumn("crawled_at", F.concat(F.lit("2026-04-01T00:00:0"), "ord"))
    out = effects.search_stage(ranked, timed, 100)
    assert [tuple(r) for r in out["citations"].orderBy("cit_id").select("cit_id", "query_id").collect()] == [(100, "Q00002"), (101, "Q00001"), (102, "Q00001")]
    assert {r.crawled_at_first for r in out["sources"].collect()} == {"2026-04-01T00:00:01", "2026-04-01T00:00:02"}
    assert [r.source_content for r in out["contents"].collect()] == ["other"]


def test_commands_from_questions_to_tables(spark, tmp_path):
    lines = lambda name, rows: (tmp_path / name).write_text("".join(json.dumps(r) + "\n" for r in rows))
    words = "It is said here that one two three four."
    models = ["sonar", "gpt-5"]
    questions = [{"query_id": f"Q0000{i}", "site": "law", "category": "Science", "question_title": f"Why {i}?", "question_url": None, "QI_label": None} for i in (3, 1, 2)]
    lines("q.jsonl", questions)
    meta = {"citations": ["http://a.org/1?utm_source=x", "http://b.com/2"]}
    full = {"sonar": "sonar", "gpt-5": "gpt-5-2025-08-07"}
    text = {"sonar": f"{words} [1][2]", "gpt-5": f"{words} [x](http://a.org/1)"}
    lines("r.jsonl", [{"question": q["question_title"], "model": full[m], "text": text[m], "meta": meta if m == "sonar" else {}} for q in questions for m in models])
    lines("p.jsonl", [{"url": "http://a.org/1", "text": "page text"}])
    lines("l.jsonl", [{"axis": "QI", "key": q["question_title"], "label": "QI2"} for q in questions] + [{"axis": a, "key": "http://a.org/1", "label": f"{a}1"} for a in ("SP", "SD", "ST")] + [{"axis": "ASF", "key": words, "label": "ASF5"}])
    folder = tmp_path / "run"
    given = cli.responder_of(None, str(tmp_path / "r.jsonl")), cli.fetcher_of(None, str(tmp_path / "p.jsonl")), cli.judge_of(None, str(tmp_path / "l.jsonl"))
    done, skipped = cli.run_all(spark, str(folder), str(tmp_path / "q.jsonl"), models, *given, start=50, retry=0.0)
    assert done and done + skipped == 14
    cit = spark.read.json(str(folder / "search" / "citations.jsonl")).orderBy("cit_id").collect()
    assert [(r.cit_id, r.query_id, r.model_short) for r in cit] == [(50 + 3 * k + j, q["query_id"], m) for k, q in enumerate(questions) for j, m in enumerate(("sonar", "sonar", "gpt-5"))]
    src = spark.read.json(str(folder / "search" / "sources.jsonl")).collect()
    assert {(r.source_url, r.crawl_yn) for r in src} == {("http://a.org/1", "Y"), ("http://b.com/2", "N")} and all(r.crawled_at_first for r in src)
    am = spark.read.parquet(str(folder / "analysis_master.parquet")).collect()
    assert len(am) == 6 and {(r.QI_label, r.SP_label, r.asf_score) for r in am} == {("QI2", "SP1", 5)}
    with pytest.raises(SystemExit):
        cli.main(["search", "--input", "x", "--models", "none", "--output", "y", "--responder", "a:b", "--fetcher", "a:b"])
    with pytest.raises(SystemExit):
        cli.main(["judge", "--output-dir", "y", "--judge", "a:b"])
    with pytest.raises(ValueError, match="sources"):
        cli.run_judge(spark, None, None, "c", None, "o", given[2])


def test_scores_of_matrix_files(spark, tmp_path):
    (tmp_path / "ipa.tsv").write_text("QI\tSP\tscore\n" + "".join(f"QI{i}\tSP{j}\t{6 - (i + j) % 5 - 1}\n" for i in range(1, 6) for j in range(1, 7)))
    rows = spark.createDataFrame([("QI1", "SP6"), ("QI2", "SP2"), ("QI9", "SP1")], "r string, c string")
    cells = M.cells_of(io.read_matrix(spark, str(tmp_path / "ipa.tsv")))
    assert [x.s for x in rows.where("r <> 'QI9'").select(M.score("ipa", "r", "c", cells).alias("s")).collect()] == [3, 1]
    with pytest.raises(Exception, match="no ipa score: QI9"):
        rows.select(M.score("ipa", "r", "c", cells).alias("s")).collect()
    two = spark.createDataFrame([("S1", "http://a"), ("S1", "http://b")], "url_id string, source_url string")
    with pytest.raises(Exception, match="one url_id for several URLs: S1"):
        M.unique_ids(two).collect()
    assert M.unique_ids(two.limit(1).union(two.limit(1))).count() == 2


def test_first_rows_item_numbers_and_strict_providers(spark):
    am = spark.createDataFrame([(2, "S1", "SD1", "ST1", "SP1"), (1, "S1", "SD2", "ST2", "SP2"), (3, "S2", "SD3", "ST1", "SP1")], "cit_id int, url_id string, SD_label string, ST_label string, SP_label string")
    assert sorted((r.url_id, r.SD_label) for r in sampling.pool(am, "SD").collect()) == [("S1", "SD2"), ("S2", "SD3")]
    assert sorted((r.url_id, r.SD_label) for r in sampling.pool(am.drop("cit_id"), "SD").collect()) == [("S1", "SD1"), ("S2", "SD3")]
    assert [(r.cit_id, r.item_id) for r in sampling.numbered(am, "SD", ["cit_id"]).orderBy("cit_id").collect()] == [(1, "SD1"), (2, "SD2"), (3, "SD3")]
    models = spark.createDataFrame([("sonar",), ("gpt-5-2025-08-07",)], "model string")
    assert [r.p for r in models.select(M.strict_provider().alias("p")).collect()] == ["Perplexity", "OpenAI"]
    with pytest.raises(Exception, match="no such model: gpt-9"):
        models.limit(1).withColumn("model", F.lit("gpt-9")).select(M.strict_provider().alias("p")).collect()


def test_merges_of_repeated_keys(spark):
    q = spark.createDataFrame([("Q1", "QI1"), ("Q2", None)], "query_id string, QI_label string")
    new = spark.createDataFrame([("Q1", "QI2", 1), ("Q1", "QI3", 2), ("Q2", "QI4", 1), (None, "QI5", 1)], "query_id string, label string, _o int")
    assert sorted(map(tuple, evaluate.merge_queries(q, new).collect())) == [("Q1", "QI3"), ("Q2", "QI4")]
    cit = spark.createDataFrame([(1, "S1", None, "Y", None)], "cit_id int, url_id string, ASF_label string, evaluation_yn string, evaluation_fail_reason string")
    src = spark.createDataFrame([("S1", "text", 1), ("S1", "more", 2)], "url_id string, content string, _o int")
    lab = spark.createDataFrame([(1, "ASF1", 1), (1, "ASF2", 2)], "cit_id int, label string, _o int")
    assert [tuple(r) for r in evaluate.merge_citations(cit, src, lab).collect()] == [(1, "S1", "ASF2", "Y", None)]
    raw = spark.createDataFrame([("u", "a"), ("u", "b")], "raw string, canonical string")
    assert evaluate.canonical_urls(spark.createDataFrame([("u",)], "url string"), raw).count() == 1


def test_streamed_counters_equal_the_batch(spark, am, tmp_path):
    from provenant.streaming import rates

    cols = am.select(*rates.KEYS)
    cols.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(cols.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = rates.start(stream, str(tmp_path / "cells"), str(tmp_path / "ck"), availableNow=True)
    q.awaitTermination(120)
    got = {r.model_short: (r.n, r.FFR) for r in rates.rates(rates.current(spark, str(tmp_path / "cells"))).collect()}
    assert got == {r.model_short: (r.n, r.FFR) for r in rates.rates(rates.cells(am)).collect()} and len(got) == 10


def test_stages_end_to_end(spark):
    from provenant.sources import stages

    meta = json.dumps({"annotations": [{"url": "http://a/1", "title": "t"}]})

    def responder(question, model):
        return f"{question} It is said that one two three four. [x](http://a/1) Other words come here too, and more. [y](http://b/2)", meta

    def fetcher(url):
        if "b/2" in url:
            raise OSError("down")
        return effects.Fetched("ok", "page text", url)

    def judge(axis, parts):
        return effects.Judged({"QI": "QI3", "SP": "SP2", "SD": "SD7", "ST": "ST1", "ASF": "ASF4"}[axis] if "page" in parts.get("content", "page") else None)

    q = spark.createDataFrame([("Q00001", "Why?", None), ("Q00002", "How?", "QI1")], "query_id string, question_title string, QI_label string")
    found = stages.search(q, "gpt-5 gpt-5-mini-2025-08-07".split(), responder, fetcher, 0.0)
    assert found["citations"].count() == 8 and found["model_responses"].count() == 4 and found["sources"].count() == 2
    src = found["sources"].withColumns({f"{a}_label": F.lit(None).cast("string") for a in ("SP", "SD", "ST")})
    out = stages.judge({"queries": q, "sources": src, "citations": found["citations"]}, found["contents"], judge, 0.0)
    assert {r.QI_label for r in out["queries"].collect()} == {"QI3"}
    assert sorted((r.crawl_yn, r.SP_label, r.SD_label, r.ST_label) for r in out["sources"].collect()) == [("N", None, None, None), ("Y", "SP2", "SD7", "ST1")]
    states = Counter((r.evaluation_yn, r.evaluation_fail_reason, r.ASF_label) for r in out["citations"].collect())
    assert states == {("Y", None, "ASF4"): 4, ("N", "crawl_fail", None): 4}
    named = q.withColumns({"site": F.lit("law"), "category": F.lit("Science")})
    master = M.build_master(named.drop("QI_label").join(out["queries"].select("query_id", "QI_label"), "query_id"), out["sources"], out["citations"])
    assert {(r.ipam_score, r.ssm_score, r.asf_score) for r in master.collect()} == {(3, 5, 4)}


def test_parts_of_effects(spark):
    follow = {"https://vertexaisearch.cloud.google.com/grounding-api-redirect/x": "http://real"}.get
    assert effects.resolve_redirect("https://vertexaisearch.cloud.google.com/grounding-api-redirect/x", follow) == "http://real"
    assert effects.resolve_redirect("https://vertexaisearch.cloud.google.com/grounding-api-redirect/y", follow).endswith("/y")
    assert effects.resolve_redirect("http://other/x", lambda u: 1 / 0) == "http://other/x"
    assert effects.admit(["sonar", "gpt-5-2025-08-07"], {"perplexity": "k", "openai": "k"}) == ["sonar", "gpt-5-2025-08-07"]
    with pytest.raises(KeyError):
        effects.admit(["none"], {})
    with pytest.raises(ValueError, match="openai"):
        effects.admit(["gpt-5"], {"openai": " "})
    rows = spark.createDataFrame([('{"label": "ST2", "reasoning": "r"}',), ('{"ST_label": "ST9"}',), ("junk",)], "x string").select(effects.parse_reply("x", "ST").alias("r")).select("r.*").collect()
    assert [tuple(r) for r in rows] == [("ST2", "r"), (None, None), (None, None)]
    one = spark.createDataFrame([("u", "c" * 40_000)], "url string, content string").select(effects.judge_message("SP").alias("m")).first().m
    assert one.startswith("<url>\nu\n</url>\n<content>\n") and len(one) < 30_100


def test_metadata_from_json(spark):
    rows = ['{"citations": ["http://a", "http://b"]}', '{"citations": {"2": "http://c"}}', '{"annotations": [{"url": "u"}]}', None, "{}"]
    got = [r.m for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").orderBy("i").select(effects.parse_meta("x").alias("m")).collect()]
    assert [m.citations for m in got] == [{1: "http://a", 2: "http://b"}, {2: "http://c"}, None, None, None] and got[2].annotations[0].url == "u"
    other = ['{"text_citations": [{"text": "It is so. And so.", "url": " http://a "}, {"cited_text": "x", "url": ""}]}', '{"native_citations": [], "text_citations": [{"cited_text": "", "text": "t", "url": "u"}]}', '{"native_citations": [{"cited_text": "a", "url": "n"}], "text_citations": [{"text": "t", "url": "u"}]}']
    other += ['{"grounding_chunks": [{"uri": "http://b"}], "grounding_supports": [{"grounding_chunk_indices": [0, 3], "text": "Said."}, {"chunk_indices": [0], "grounding_chunk_indices": [5], "text": "More."}]}']
    rows = spark.createDataFrame([(i, "google" if "ground" in x else "anthropic", x) for i, x in enumerate(other)], "i int, provider_key string, m string")
    cited = extract.extract(rows.select("i", "provider_key", F.lit("").alias("raw_response"), effects.parse_meta("m").alias("meta"))).orderBy("i", "ord").collect()
    assert [(r.i, r.url, r.cited_sentence, r.ord) for r in cited] == [(0, "http://a", "It is so. And so.", 1), (1, "u", "t", 1), (2, "n", "a", 1), (3, "http://b", "Said.", 1), (3, "http://b", "More.", 3)]


def test_visible_text(spark):
    from provenant.functions.html import visible

    assert visible("<head><title>t</title></head><body><p>a &amp; <b>b</b>\n c<br>d</p><script>x()</script><div>e</div></body>") == "a & b c\nd\ne"
    assert visible(None) == "" and visible("<p>") == "" and visible("plain < text") == "plain < text"


def test_large_tables_are_joined_in_tasks_by_their_size(spark, sf_dir, tmp_path, monkeypatch):
    from provenant.plans import adapter
    from provenant.sources import durable

    kept = [durable.tasks_for(adapter.citations(spark, sf_dir)), durable.estimated(spark.createDataFrame([(1,)], "x int").checkpoint())]
    assert kept == [0, 0]
    rows = lambda: sorted(map(str, tables.response_exposure(adapter.master(spark, sf_dir)).collect()))
    want = rows()
    monkeypatch.setattr(durable, "TASK_BYTES", durable.estimated(adapter.citations(spark, sf_dir)) // 20)
    n = durable.tasks_for(adapter.citations(spark, sf_dir))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for limit in (before, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            assert n > 16 and adapter.master(spark, sf_dir).rdd.getNumPartitions() >= n > int(spark.conf.get("spark.sql.shuffle.partitions"))
            assert rows() == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
