"""External effects behind small protocols: fetching pages, asking models, judging.

Each runs in `mapInPandas`, a thread pool a partition bounding what is in flight.
Live implementations belong to the user; the ones here replay tables, so that the
stages can be run and tested offline.  Results of an effect should be written before
they are used: a retried task calls it again.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime
from typing import Protocol
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extract, text, urls
from ..operators import evaluate
from ..operators.master import colliding_ids, where_yes

CRAWL_CONCURRENCY, CRAWL_TIMEOUT_MS, JUDGE_CONCURRENCY = 5, 15_000, 20
#: Of fetches and of the rules of robots.txt asked for.
USER_AGENT = "Mozilla/5.0 (compatible; provenant)"
SYSTEM_PROMPT = "Answer the question accurately and completely, with help of the search tool where outside knowledge is needed."
AXES = {"QI": 5, "SP": 6, "SD": 10, "ST": 6, "ASF": 5}
#: Parts of a judge's user message, by axis.
MESSAGE = {"QI": ("question",), "SP": ("url", "content"), "SD": ("url", "content"), "ST": ("url", "content"), "ASF": ("cited_sentence", "source_content")}


@dataclass(frozen=True)
class Fetched:
    status: str
    content: str | None = None
    final_url: str | None = None


@dataclass(frozen=True)
class Judged:
    label: str | None = None
    reasoning: str | None = None
    error: str | None = None


class Fetcher(Protocol):
    def __call__(self, url: str) -> Fetched: ...


class Responder(Protocol):
    def __call__(self, question: str, model: str) -> tuple[str, str]: ...


class Judge(Protocol):
    def __call__(self, axis: str, parts: dict[str, str]) -> Judged: ...


def delay(error: Exception, attempt: int, base: float = 2.0) -> float:
    """Seconds to wait after a failed attempt (from 1): a minute if the rate is limited, else doubling."""
    text = str(error).lower()
    return 60.0 if "429" in text or "rate limit" in text else base * 2 ** (attempt - 1)


def with_retry(call: Callable[[], object], attempts: int = 3, base: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> object:
    """The first success; the last error is raised."""
    for attempt in range(1, attempts + 1):
        try:
            return call()
        except Exception as e:
            if attempt == attempts:
                raise
            sleep(delay(e, attempt, base))
    raise ValueError("attempts must be positive")


def judge_with_retry(judge: Judge, axis: str, parts: dict[str, str], attempts: int = 3, base: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> Judged:
    """As with_retry, but failure is a result without a label; a label outside the axis is one too."""
    try:
        got = with_retry(lambda: judge(axis, parts), attempts, base, sleep)
    except Exception as e:  # noqa: BLE001  every failure of a live judge is a row
        return Judged(error=str(e))
    known = {f"{axis}{i}" for i in range(1, AXES[axis] + 1)}
    return got if got.label in known else Judged(None, got.reasoning, got.error or f"no such label: {got.label}")


class Robots:
    """robots.txt by host, read once however many threads ask; a host whose file can't be read is allowed unless `default` says otherwise."""

    def __init__(self, read: Callable[[str], str | None], default: bool = True):
        self.read, self.default, self.known, self.busy = read, default, {}, {}
        self.lock = threading.Lock()

    def __getstate__(self) -> dict:
        return {"read": self.read, "default": self.default, "known": {}, "busy": {}}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, lock=threading.Lock())

    def allowed(self, url: str, agent: str = USER_AGENT) -> bool:
        scheme, _, rest = url.partition("://")
        site = f"{scheme}://{rest.split('/')[0].lower()}"
        with self.lock:
            one = self.busy.setdefault(site, threading.Lock())
        with one:
            if site not in self.known:
                self.known[site] = self._rules(site)
        parser = self.known[site]
        return self.default if parser is None else parser.can_fetch(agent, url)

    def _rules(self, site: str) -> RobotFileParser | None:
        try:
            text = self.read(f"{site}/robots.txt")
        except Exception:  # noqa: BLE001
            text = None
        if text is None:
            return None
        parser = RobotFileParser()
        parser.parse(text.splitlines())
        return parser


#: Tasks over which the URLs of one host are spread at most.
HOST_TASKS = 8


def fetch_pages(
    found: DataFrame,
    fetcher: Fetcher,
    concurrency: int = CRAWL_CONCURRENCY,
    cap: int = 50_000,
    robots: Robots | None = None,
    timeout_ms: int = CRAWL_TIMEOUT_MS,
    follow: Callable[[str], str | None] | None = None,
    host_tasks: int = HOST_TASKS,
) -> DataFrame:
    """url, status, content, final_url, crawled_at, ord for each distinct url.

    found: url, and ord if there is an order (the least of a URL counts and is kept;
    else 0).  Grounding redirects are followed first, then robots.txt is asked
    (status blocked_by_robots); an exception or a fetch beyond the timeout is a failed
    one.  A fetcher that is a context manager is entered once a task, for what its
    fetches share (a browser, say).  crawled_at: when the fetch began, ISO.  A host's URLs go to at most
    `host_tasks` tasks, each with `concurrency` threads; within a task results keep the order of the URLs.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        began: dict[str, str] = {}

        def one(url: str) -> tuple:
            began[url] = datetime.now().isoformat()
            target = resolve_redirect(url, follow) if follow else url
            if robots is not None and not robots.allowed(target):
                return "blocked_by_robots", None, target
            got = fetch(target)
            return got.status, None if got.content is None else got.content[:cap], got.final_url or target

        shared = hasattr(fetcher, "__enter__")
        fetch = fetcher.__enter__() if shared else fetcher
        pool = ThreadPoolExecutor(concurrency)
        try:
            for pdf in batches:
                pdf = pdf.sort_values(["ord", "url"])
                asked = [(u, o, pool.submit(one, u)) for u, o in zip(pdf["url"], pdf["ord"])]
                rows = []
                for url, place, job in asked:
                    try:
                        status, content, final = _patient(job, url, began, timeout_ms / 1000)
                    except Exception:  # noqa: BLE001
                        status, content, final = "failed", None, url
                    rows.append((url, status, content, final, began.get(url) or datetime.now().isoformat(), place))
                yield pd.DataFrame(rows, columns=["url", "status", "content", "final_url", "crawled_at", "ord"])
        finally:
            pool.shutdown(wait=False, cancel_futures=True)
            if shared:
                fetcher.__exit__(None, None, None)

    place = F.col("ord") if "ord" in found.columns else F.lit(0)
    distinct = found.where("url IS NOT NULL").groupBy("url").agg(F.min(place.cast("long")).alias("ord"))
    spread = distinct.repartition(urls.host("url"), F.pmod(F.xxhash64("url"), F.lit(host_tasks)))
    return spread.mapInPandas(run, "url string, status string, content string, final_url string, crawled_at string, ord long")


def _patient(job, url: str, began: dict[str, str], seconds: float) -> tuple:
    """The result of a job that may take so long from when it began (it may wait for a free thread before)."""
    while True:
        try:
            return job.result(timeout=seconds)
        except TimeoutError:
            if job.done() or url in began and (datetime.now() - datetime.fromisoformat(began[url])).total_seconds() >= seconds:
                if job.done():
                    return job.result()
                raise


def ask_models(questions: DataFrame, models: DataFrame, responder: Responder, concurrency: int = 10, attempts: int = 3, base: float = 2.0) -> DataFrame:
    """query_id, model, raw_response, meta_json for each question and model (a table of at most ten rows); failed calls are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(r) -> tuple | None:
            try:
                text, meta = with_retry(lambda: responder(r.question_title, r.model), attempts, base)
            except Exception:  # noqa: BLE001
                return None
            return r.query_id, r.model, text, meta

        with ThreadPoolExecutor(concurrency) as pool:
            for pdf in batches:
                rows = [x for x in pool.map(one, pdf.itertuples()) if x is not None]
                yield pd.DataFrame(rows, columns=["query_id", "model", "raw_response", "meta_json"])

    pairs = questions.select("query_id", "question_title", F.explode(F.array(*(F.lit(r["model"]) for r in models.select("model").collect()))).alias("model"))
    return pairs.mapInPandas(run, "query_id string, model string, raw_response string, meta_json string")


def judge_rows(rows: DataFrame, axis: str, judge: Judge, key: str, parts: dict[str, str], concurrency: int = JUDGE_CONCURRENCY, attempts: int = 3, base: float = 2.0) -> DataFrame:
    """key, label, reasoning, error of each row; parts: name in the message to column."""
    schema = f"{key} {dict(rows.dtypes)[key]}, label string, reasoning string, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(row: dict) -> tuple:
            got = judge_with_retry(judge, axis, {n: row[c] for n, c in parts.items()}, attempts, base)
            return row[key], got.label, got.reasoning, got.error

        with ThreadPoolExecutor(concurrency) as pool:
            for pdf in batches:
                yield pd.DataFrame([*pool.map(one, pdf.to_dict("records"))], columns=[key, "label", "reasoning", "error"])

    return rows.select(key, *dict.fromkeys(parts.values())).mapInPandas(run, schema)


# -- replay


def replay_fetch(found: DataFrame, pages: DataFrame) -> DataFrame:
    """What fetch_pages returns, from a table url, html and, if there, crawled_at."""
    at = F.col("crawled_at") if "crawled_at" in pages.columns else F.lit(None)
    stored = pages.groupBy("url").agg(F.max(F.struct(F.col("html").alias("content"), at.cast("string").alias("crawled_at"))).alias("p"))
    place = F.col("ord") if "ord" in found.columns else F.lit(0)
    wanted = found.where("url IS NOT NULL").groupBy("url").agg(F.min(place.cast("long")).alias("ord"))
    ok = F.col("p.content").isNotNull()
    return wanted.join(stored, "url", "left").select("url", F.when(ok, "ok").otherwise("failed").alias("status"), F.substring("p.content", 1, 50_000).alias("content"), F.col("url").alias("final_url"), "p.crawled_at", "ord")


class ReplayFetcher:
    """Pages from a dict of URL to text."""

    def __init__(self, pages: dict[str, str]):
        self.pages = pages

    def __call__(self, url: str) -> Fetched:
        return Fetched("ok", self.pages[url], url) if url in self.pages else Fetched("failed", None, url)


class ReplayResponder:
    """Responses and metadata from a dict of (question, model)."""

    def __init__(self, responses: dict[tuple[str, str], tuple[str, str]]):
        self.responses = responses

    def __call__(self, question: str, model: str) -> tuple[str, str]:
        return self.responses[question, model]


class ReplayJudge:
    """Labels from a dict of (axis, first part of the message)."""

    def __init__(self, labels: dict[tuple[str, str], str]):
        self.labels = labels

    def __call__(self, axis: str, parts: dict[str, str]) -> Judged:
        return Judged(self.labels.get((axis, next(iter(parts.values())))))


# -- search stage


def search_stage(cited: DataFrame, fetched: DataFrame, start: int = 1) -> dict[str, DataFrame]:
    """citations, sources, contents and shared_ids from cited rows and fetched pages.

    cited: query_id, model, model_short, provider, url, cited_sentence, ord (as extract
    returns, with the keys of the response); fetched: url (normalised), status,
    content, final_url, and, if there, crawled_at and ord.  cit_ids begin with start and
    follow query_ord and model_ord, where cited has them, else query_id and model, then ord.
    Of URLs with one canonical form the first in order of ord is the source, with its crawl time.
    shared_ids: cit_id, url_id and source_url of citations whose url_id stands for several URLs.
    """
    raw = cited.withColumn("raw", urls.normalise_url("url"))
    canonical = F.when(F.col("status") == "ok", urls.normalise_url("final_url")).otherwise(F.col("url"))
    at = F.col("crawled_at") if "crawled_at" in fetched.columns else F.lit(None)
    place = F.col("ord") if "ord" in fetched.columns else F.lit(0)
    pages = fetched.select(F.col("url").alias("raw"), canonical.alias("canonical"), "status", "content", at.cast("string").alias("crawled_at_first"), place.cast("long").alias("place"))
    seen = evaluate.first_wins(pages.withColumn("s", evaluate.crawl_state("status", "content")), "canonical", ["place", "raw"])
    sources = seen.select(urls.url_id("canonical").alias("url_id"), F.col("canonical").alias("source_url"), urls.host_tier("canonical").alias("host_tier"), "s.crawl_yn", "s.failure_category", "s.clen", "crawled_at_first", "content")
    rows = raw.join(pages.select("raw", "canonical"), "raw", "left").withColumn("canonical", F.coalesce("canonical", "raw"))
    rows = rows.join(sources.select(F.col("source_url").alias("canonical"), "crawl_yn"), "canonical", "left")
    gate = evaluate.evaluation_gate("crawl_yn", "cited_sentence")
    order = [c if c in cited.columns else other for c, other in (("query_ord", "query_id"), ("model_ord", "model"))]
    rows = rows.select(
        *dict.fromkeys(order), *[c for c in ("query_id", "model") if c not in order], urls.url_id("canonical").alias("url_id"), "model_short", "provider", "cited_sentence",
        F.length("cited_sentence").cast("long").alias("cited_len"), F.lit(None).cast("string").alias("ASF_label"), gate.alias("g"), "ord", F.col("canonical").alias("source_url"),
    ).select("*", "g.*").drop("g")
    numbered = evaluate.sequence(rows, [*order, "ord", "url_id", "cited_sentence"], start=start - 1)
    citations = numbered.select("cit_id", "query_id", "url_id", "model", "model_short", "provider", "cited_sentence", "cited_len", "ASF_label", "evaluation_yn", "evaluation_fail_reason")
    shared = numbered.join(colliding_ids(sources).select("url_id"), "url_id", "left_semi").select("cit_id", "url_id", "source_url")
    return {"citations": citations, "shared_ids": shared, "sources": sources.drop("content"), "contents": where_yes(sources, "crawl_yn").select("url_id", "source_url", F.col("content").alias("source_content"))}


# -- parts of live implementations


def resolve_redirect(url: str, follow: Callable[[str], str | None]) -> str:
    """Where a search provider's grounding redirect leads; any other URL, or one that can't be followed, is itself."""
    host, _, path = url.partition("://")[2].partition("/")
    if host.lower() != urls._REDIRECTOR or not path.startswith(("grounding-api-redirect/", "grounding-redirect/")):
        return url
    try:
        return follow(url) or url
    except Exception:  # noqa: BLE001
        return url


def admit(models: list[str], keys: dict[str, str]) -> list[str]:
    """Full ids of the models asked for; unknown ones, or without a key for their provider, are errors."""
    from ..operators import dims

    out = []
    for m in models:
        found = next((x for x in dims.MODELS if m in x[:2]), None)
        if found is None:
            raise KeyError(f"no such model: {m!r}")
        if not keys.get(found[3], "").strip():
            raise ValueError(f"no key for provider {found[3]}, which {m} needs")
        out.append(found[1])
    return out


def judge_message(axis: str) -> Column:
    """The user message of a judge from columns named as its parts; contents are capped."""
    cap = {"content": 30_000, "source_content": 30_000}
    return text.tagged(**{p: text.truncate(p, cap[p]) if p in cap else F.col(p) for p in MESSAGE[axis]})


def parse_reply(reply: Column | str, axis: str) -> Column:
    """label and reasoning of a judge's JSON reply; a label outside the axis is null."""
    got = F.from_json(reply, f"struct<{axis}_label:string,label:string,reasoning:string>")
    label = F.coalesce(got["label"], got[f"{axis}_label"])
    return F.struct(F.when(label.isin(*[f"{axis}{i}" for i in range(1, AXES[axis] + 1)]), label).alias("label"), got["reasoning"].alias("reasoning"))


def parse_meta(meta: Column | str) -> Column:
    """A response's metadata as a struct; what isn't there is null.

    Citations may be a map or a list (numbered from 1).  Native citations may be called
    text_citations, their text text, and chunk indices grounding_chunk_indices.
    """
    meta = F.col(meta) if isinstance(meta, str) else meta
    quoted = "array<struct<cited_text:string,url:string,text:string>>"
    kind = (
        extract.META.replace("citations:map<int,string>", "citations:string")
        .replace("native_citations:array<struct<cited_text:string,url:string>>", f"native_citations:{quoted},text_citations:{quoted}")
        .replace("chunk_indices:array<int>,", "chunk_indices:array<int>,grounding_chunk_indices:array<int>,")
    )
    got = F.from_json(meta, kind)
    urls_ = F.from_json(got["citations"], "array<string>")
    listed = F.map_from_arrays(F.transform(urls_, lambda _, i: i + 1), urls_)
    named = F.transform_keys(F.from_json(got["citations"], "map<string,string>"), lambda k, _: k.try_cast("int"))
    numbered = F.when(F.ltrim(got["citations"]).startswith("["), listed).otherwise(named)
    cited = F.when(F.size(got["native_citations"]) > 0, got["native_citations"]).otherwise(got["text_citations"])
    full = lambda x: F.when(x != "", x)
    native = F.transform(cited, lambda c: F.struct(F.coalesce(full(c["cited_text"]), full(c["text"])).alias("cited_text"), c["url"].alias("url")))
    some = lambda x: F.when(F.size(x) > 0, x)
    supports = F.transform(got["grounding_supports"], lambda g: F.struct(F.coalesce(some(g["chunk_indices"]), g["grounding_chunk_indices"]).alias("chunk_indices"), g["text"].alias("text")))
    return F.struct(got["annotations"].alias("annotations"), numbered.alias("citations"), got["search_results"].alias("search_results"), native.alias("native_citations"), got["grounding_chunks"].alias("grounding_chunks"), supports.alias("grounding_supports"))
