"""Commands: search, judge, export, master, tables, run (all of these in order), samples, select.

    python -m provenant.cli search --input queries.jsonl --models sonar gpt-5 --output run/search --responder pkg:make --fetcher pkg:make [--cit-id-start 1] [--save-content]
    python -m provenant.cli judge --queries queries.jsonl --sources run/search/sources.jsonl --citations run/search/citations.jsonl --content-jsonl run/search/contents.jsonl --output-dir run/judge --judge pkg:make
    python -m provenant.cli run run --input queries.jsonl --models sonar --responder pkg:make --fetcher pkg:make --judge pkg:make
    python -m provenant.cli tables --input master.parquet --output-dir out [--with-validation]
    python -m provenant.cli export --jsonl-dir run --out-dir parquet
    python -m provenant.cli master --parquet-dir parquet --output master.parquet
    python -m provenant.cli samples --master-parquet master.parquet --output-dir out [--seed 42]
    python -m provenant.cli select queries.parquet --output sample.jsonl

pkg:make names a function without arguments that returns a responder, fetcher or judge
(sources/effects.py); instead of them recorded answers can be replayed:
--responses-jsonl (question, model, text, meta), --pages-jsonl (url, text), --labels-jsonl (axis, key, label).
"""

from __future__ import annotations

import argparse
import importlib
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import dims, sampling, tables, validation
from .operators import master as M
from .sources import effects, io, schemas, stages

LOG = logging.getLogger("provenant")


def logger(folder: str | None = None) -> logging.Logger:
    """Messages to stderr, and to a file in folder."""
    if not LOG.handlers:
        LOG.setLevel(logging.INFO)
        LOG.addHandler(logging.StreamHandler())
        if folder:
            Path(folder).mkdir(parents=True, exist_ok=True)
            LOG.addHandler(logging.FileHandler(Path(folder, "provenant.log"), encoding="utf-8"))
        for h in LOG.handlers:
            h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    return LOG


class TooSmall(ValueError):
    """A table can't be computed from so few rows; it is skipped."""


def _check(am: DataFrame, name: str) -> None:
    if name == "temporal" and "crawled_at_first" not in am.columns:
        raise TooSmall("no crawl times")
    if name in ("three_axis", "ymyl_ssfr"):
        missing = am.where(" OR ".join(f"{a}_score IS NULL" for a in (tables.AXES if name == "three_axis" else ["ssm"])))
        if not missing.isEmpty():
            raise TooSmall("scores are missing")


def run_tables(spark: SparkSession, path: str, out: str, with_validation: bool = False) -> tuple[int, int]:
    """All result tables of a fact table; tables written and skipped."""
    am = spark.read.parquet(path)
    beside = io.sibling(path)
    if beside and "url_id" in am.columns:
        am = tables.with_crawl_times(am, spark.read.parquet(beside))
    am = am.select(*[c for c in ("query_id", "model_short", "category", "SP_label", "SD_label", "ST_label", "asf_score", "ssm_score", "ipam_score", "crawled_at_first") if c in am.columns])
    done = skipped = 0
    for name, make in tables.TABLES.items():
        try:
            _check(am, name)
            n = io.save_table(make(am), name, out)
        except ValueError as e:
            LOG.warning("skipped %s: %s", name, e)
            skipped += 1
            continue
        LOG.info("wrote %s, %d rows", name, n)
        done += 1
    if with_validation:
        run_validation(spark, str(Path(path).parent), out)
    return done, skipped


def run_validation(spark: SparkSession, folder: str, out: str) -> None:
    """Agreement of the judge, and reliability of both matrices, from the human evaluation tables in a folder."""
    found = [(a, p) for a in validation.AXES if (p := Path(folder, f"{a.lower()}_human_eval.parquet")).exists()]
    parts = [spark.read.parquet(str(p)).select(F.lit(a).alias("task"), F.col("gpt4o_mini_label").alias("judge_label"), "human_labels") for a, p in found]
    if parts:
        both = parts[0]
        for p in parts[1:]:
            both = both.unionByName(p)
        r3 = lambda x: io.np_round(x, 3)
        rows = [{"dimension": r["task"], "n": r["n"], "raw_agr": r3(r["raw_agr"]), "kappa_cons": r3(r["kappa_cons"]), "kappa_ci": f"[{r['lo']:.3f}, {r['hi']:.3f}]", "kappa_pair": r3(r["kappa_pair"]), "bal_acc": r3(r["bal_acc"])} for r in sorted(validation.judge_kappa(both).collect(), key=lambda r: r["ord"])]
        io.write_tsv(rows, f"{out}/tab_c_judge_kappa.tsv", "dimension n raw_agr kappa_cons kappa_ci kappa_pair bal_acc".split(), None)
    rows = []
    for which, name, file, r, c in (("ipa", "IPA", "ipam", "QI_label", "SP_label"), ("ss", "SS", "ssm", "SD_label", "ST_label")):
        p = Path(folder, f"{file}_human_eval.parquet")
        if not p.exists():
            continue
        raw = spark.read.parquet(str(p))
        cells = validation.with_design(raw.withColumn("cell", F.concat_ws("|", r, c)), which, r, c)
        total = cells.withColumn("grp", F.lit(name))
        if which == "ss":
            title = F.concat_ws(" ", r, F.col("SD_name") if "SD_name" in raw.columns else F.lit(None).cast("string"))
            total = total.unionByName(cells.withColumn("grp", title))
        for x in sorted(validation.matrix_validation(total.select("grp", "cell", "annotator_scores", "design")).collect(), key=lambda x: (x["grp"] == name, int("".join(filter(str.isdigit, x["grp"].split()[0])) or 0))):
            whole = x["grp"] == name
            code = x["grp"].split()[0]
            row = f"Aggregate ({len(dims.IPA if which == 'ipa' else dims.SS)} cells)" if whole else x["grp"]
            rows.append({"matrix": name, "row": row, "ymyl": "Y" if code in dims.HIGH_STAKES else "", "n": 100 if whole and which == "ss" else 10, "icc_2k": io.np_round(x["icc"], 3), "icc_ci": f"[{x['lo']:.2f}, {x['hi']:.2f}]", "pearson_r": io.np_round(x["pearson_r"], 3), "mad": io.np_round(x["mad"], 3)})
    if rows:
        io.write_tsv(rows, f"{out}/tab_c_validation.tsv", [*rows[0]], None)


def made(name: str):
    """What the function pkg.module:function returns."""
    module, _, attr = name.partition(":")
    return getattr(importlib.import_module(module), attr)()


def _records(path: str) -> list[dict]:
    """Recorded answers for a replay, which are small."""
    return [json.loads(x) for x in Path(path).read_text(encoding="utf-8").splitlines() if x.strip()]


def responder_of(name: str | None, path: str | None) -> effects.Responder:
    if name:
        return made(name)
    return effects.ReplayResponder({(r["question"], r["model"]): (r["text"], json.dumps(r.get("meta") or {})) for r in _records(path)})


def fetcher_of(name: str | None, path: str | None) -> effects.Fetcher:
    return made(name) if name else effects.ReplayFetcher({r["url"]: r["text"] for r in _records(path)})


def judge_of(name: str | None, path: str | None) -> effects.Judge:
    return made(name) if name else effects.ReplayJudge({(r["axis"], r["key"]): r["label"] for r in _records(path)})


def run_search(spark: SparkSession, path: str, models: list[str], out: str, responder: effects.Responder, fetcher: effects.Fetcher, start: int = 1, save_content: bool = False, robots: effects.Robots | None = None, retry: float = 2.0) -> dict[str, int]:
    """Questions to citations, shared_ids, sources, model_responses and, if wanted, contents as JSON lines; rows of each."""
    found = stages.search(io.read_table(spark, path, "queries"), models, responder, fetcher, retry, start, robots)
    counts = {}
    for name, df in found.items():
        if name != "contents" or save_content:
            io.write_jsonl(df, f"{out}/{name}.jsonl", None if name in ("contents", "shared_ids") else name)
            counts[name] = df.count()
            LOG.info("wrote %s, %d rows", name, counts[name])
    return counts


def run_judge(spark: SparkSession, queries: str | None, sources: str | None, citations: str | None, contents: str | None, out: str, judge: effects.Judge, concurrency: int = effects.JUDGE_CONCURRENCY, retry: float = 2.0) -> dict[str, int]:
    """The tables given, with labels, as JSON lines; rows of each."""
    if not (queries or sources or citations):
        raise ValueError("one of queries, sources and citations is needed")
    if citations and not sources:
        raise ValueError("citations need sources, by which their contents are found")
    tables = {n: io.read_table(spark, p, n) for n, p in (("queries", queries), ("sources", sources), ("citations", citations)) if p}
    stored = io.read_jsonl(spark, contents, "contents") if contents else spark.createDataFrame([], "url_id string, source_url string, source_content string")
    beside = io.sibling(citations, "shared_ids.jsonl") if citations else None
    shared = io.read_jsonl(spark, beside, "shared_ids") if beside else None
    counts = {}
    for name, df in stages.judge(tables, stored, judge, retry, concurrency, shared).items():
        io.write_jsonl(df, f"{out}/{name}.judged.jsonl", name)
        counts[name] = df.count()
        LOG.info("wrote %s.judged, %d rows", name, counts[name])
    return counts


def run_all(spark: SparkSession, folder: str, path: str, models: list[str], responder: effects.Responder, fetcher: effects.Fetcher, judge: effects.Judge, start: int = 1, robots: effects.Robots | None = None, retry: float = 2.0) -> tuple[int, int]:
    """search, judge, export, master and tables in one folder; tables written and skipped."""
    run_search(spark, path, models, f"{folder}/search", responder, fetcher, start, True, robots, retry)
    at = f"{folder}/search"
    run_judge(spark, path, f"{at}/sources.jsonl", f"{at}/citations.jsonl", f"{at}/contents.jsonl", f"{folder}/judge", judge, retry=retry)
    run_export(spark, folder, f"{folder}/parquet")
    run_master(spark, f"{folder}/parquet", f"{folder}/analysis_master.parquet")
    return run_tables(spark, f"{folder}/analysis_master.parquet", f"{folder}/d_tables")


def run_export(spark: SparkSession, folder: str, out: str) -> dict[str, str]:
    """Judged JSON lines, checked, to the four release tables; beside them shared_ids, if the search wrote it."""
    judged = {name: io.read_jsonl(spark, io.find(folder, file), name, strict=True) for name, file in io.JUDGED.items()}
    paths = {}
    for name, df in M.release(judged).items():
        paths[name] = f"{out}/{name}.parquet"
        df.write.mode("overwrite").parquet(paths[name])
    try:
        shared = io.read_jsonl(spark, io.find(folder, "shared_ids.jsonl"), "shared_ids")
    except FileNotFoundError:
        if not io.exists(f"{out}/shared_ids.parquet"):
            return paths
        shared = spark.createDataFrame([], schemas.struct("shared_ids"))  # that of an earlier export goes
    shared.write.mode("overwrite").parquet(f"{out}/shared_ids.parquet")
    return paths


def run_master(spark: SparkSession, folder: str, out: str, ipa: str | None = None, ss: str | None = None) -> None:
    """The fact table of release tables; ipa, ss: TSV files of scoring matrices instead of the built-in ones."""
    matrices = {n: io.read_matrix(spark, p) for n, p in (("ipa", ipa), ("ss", ss)) if p}
    t = {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in ("queries", "sources", "citations")}
    shared = spark.read.parquet(f"{folder}/shared_ids.parquet") if io.exists(f"{folder}/shared_ids.parquet") else None
    src = M.unique_ids(t["sources"]) if shared is None else t["sources"]
    M.build_master(t["queries"], src, t["citations"], matrices, shared).write.mode("overwrite").parquet(out)


def run_samples(spark: SparkSession, path: str, out: str, seed: int = sampling.SEED) -> None:
    """Items for human evaluation of each axis, with a report on their spread."""
    am = spark.read.parquet(path)
    for axis, key in sampling.SUBJECT.items():
        sample = sampling.greedy(am, axis, seed).cache()
        label = f"{axis}_label"
        rows = sorted(sample.collect(), key=lambda r: (int(r[label][2:]), str(r[key])))  # 200 at most
        Path(out).mkdir(parents=True, exist_ok=True)
        items = [{"task": axis, key: r[key], "gpt4o_mini_label": r[label], "item_id": f"{axis}{i}"} for i, r in enumerate(rows, 1)]
        _lines(items, f"{out}/{axis.lower()}.jsonl")
        counts: dict[str, int] = {}
        for r in rows:
            counts[r[label]] = counts.get(r[label], 0) + 1
        spread = {r["column"]: {"distinct": r["distinct"], "min": r["min"], "max": r["max"], "std": round(r["std"], 3), "max_dev": round(r["max_dev"], 4)} for r in sampling.report(sample, axis).collect()}
        io.write_json({"n": len(rows), "primary_counts": dict(sorted(counts.items())), "primary_match_alloc": counts == sampling.QUOTAS[axis], "secondary": {c: spread[c] for c in sampling.DIVERSITY[axis] if c in spread}}, f"{out}/{axis.lower()}_validation.json")
        sample.unpersist()
    rows = sorted(sampling.fidelity_sample(am, ("cit_id",), seed).collect(), key=lambda r: (r["layer"], r["model_short"] if r["layer"] == 1 else "", r["ASF_label"], r["cit_id"]))
    _lines([dict(task="ASF", cit_id=r["cit_id"], gpt4o_mini_label=r["ASF_label"], item_id=f"ASF{i}") for i, r in enumerate(rows, 1)], f"{out}/asf.jsonl")
    one, two = {}, {}
    for r in rows:
        k, d = (f"{r['model_short']} | {r['ASF_label']}", one) if r["layer"] == 1 else (r["ASF_label"], two)
        d[k] = d.get(k, 0) + 1
    io.write_json({"total": len(rows), "layer1": one, "layer2": two}, f"{out}/asf_validation.json")


def _lines(items: list[dict], path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text("".join(json.dumps(x, ensure_ascii=False) + "\n" for x in items), encoding="utf-8")


def run_select(spark: SparkSession, path: str, out: str) -> None:
    rows = sampling.one_query_each(spark.read.parquet(path)).collect()  # three
    _lines([r.asDict() for r in sorted(rows, key=lambda r: r["QI_label"])], out)


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="provenant", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = ap.add_subparsers(dest="command", required=True)
    p = sub.add_parser("tables")
    p.add_argument("--input", required=True)
    p.add_argument("--with-validation", action="store_true", help="agreement and reliability too")
    p.add_argument("--output-dir", required=True)
    p = sub.add_parser("export")
    p.add_argument("--jsonl-dir", required=True)
    p.add_argument("--out-dir", required=True)
    p = sub.add_parser("master")
    p.add_argument("--parquet-dir", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--ipa-matrix")
    p.add_argument("--ss-matrix")
    p = sub.add_parser("samples")
    p.add_argument("--master-parquet", required=True)
    p.add_argument("--output-dir", required=True)
    p.add_argument("--seed", type=int, default=sampling.SEED)
    p = sub.add_parser("select")
    p.add_argument("queries_parquet")
    p.add_argument("--output", required=True)
    for name in ("search", "run"):
        p = sub.add_parser(name)
        if name == "run":
            p.add_argument("folder")
        p.add_argument("--input", required=True)
        p.add_argument("--models", nargs="+", required=True)
        p.add_argument("--cit-id-start", type=int, default=1)
        p.add_argument("--responder")
        p.add_argument("--responses-jsonl")
        p.add_argument("--fetcher")
        p.add_argument("--pages-jsonl")
        p.add_argument("--robots", help="a function that makes the reader of robots.txt")
        if name == "search":
            p.add_argument("--output", required=True)
            p.add_argument("--save-content", action="store_true")
    sub.choices["run"].add_argument("--judge")
    sub.choices["run"].add_argument("--labels-jsonl")
    p = sub.add_parser("judge")
    for name in ("queries", "sources", "citations", "content-jsonl", "judge", "labels-jsonl"):
        p.add_argument(f"--{name}")
    p.add_argument("--output-dir", required=True)
    p.add_argument("--concurrency", type=int, default=effects.JUDGE_CONCURRENCY)
    a = ap.parse_args(argv)
    for one, other in (("responder", "responses_jsonl"), ("fetcher", "pages_jsonl"), ("judge", "labels_jsonl")):
        if hasattr(a, one) and not (getattr(a, one) or getattr(a, other)):
            ap.error(f"--{one} or --{other.replace('_', '-')} is needed")
    if a.command == "judge" and not (a.queries or a.sources or a.citations):
        ap.error("one of --queries, --sources and --citations is needed")
    if hasattr(a, "models"):
        unknown = [m for m in a.models if not any(m in x[:2] for x in dims.MODELS)]
        if unknown:
            ap.error(f"no such models: {', '.join(unknown)}")
    logger()
    spark = SparkSession.builder.appName("provenant").getOrCreate()
    if a.command == "tables":
        run_tables(spark, a.input, a.output_dir, a.with_validation)
    elif a.command == "export":
        run_export(spark, a.jsonl_dir, a.out_dir)
    elif a.command == "master":
        run_master(spark, a.parquet_dir, a.output, a.ipa_matrix, a.ss_matrix)
    elif a.command in ("search", "run"):
        given = responder_of(a.responder, a.responses_jsonl), fetcher_of(a.fetcher, a.pages_jsonl)
        robots = effects.Robots(made(a.robots)) if a.robots else None
        if a.command == "search":
            run_search(spark, a.input, a.models, a.output, *given, a.cit_id_start, a.save_content, robots)
        else:
            run_all(spark, a.folder, a.input, a.models, *given, judge_of(a.judge, a.labels_jsonl), a.cit_id_start, robots)
    elif a.command == "judge":
        run_judge(spark, a.queries, a.sources, a.citations, a.content_jsonl, a.output_dir, judge_of(a.judge, a.labels_jsonl), a.concurrency)
    elif a.command == "samples":
        run_samples(spark, a.master_parquet, a.output_dir, a.seed)
    else:
        run_select(spark, a.queries_parquet, a.output)


if __name__ == "__main__":
    main()
