"""Citations of a model response: one row for each, by provider.

Responses of all providers are read once: what is native to a provider is shaped by
columns, and one pass over Arrow batches resolves inline markers and scans sentences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.durable import lean
from .text import joined_sentences, strip_url_list

_TARGET = r"[(](http(?:s|)://[^)]+)[)]"
_LINK = re.compile(r"\[([^]]+)]" + _TARGET)
_NUMBERED_LINK = re.compile(r"\[{2}(\d+)]{2}" + _TARGET)
_MARK = re.compile(r"\[(\d+)]")
META = (
    "struct<annotations:array<struct<url:string,title:string,start_index:int,end_index:int>>,citations:map<int,string>,search_results:array<struct<url:string>>,"
    "native_citations:array<struct<cited_text:string,url:string>>,grounding_chunks:array<struct<title:string,uri:string>>,grounding_supports:array<struct<chunk_indices:array<int>,text:string>>>"
)
#: Responses that are Python objects at a time, and characters of citations that are sent on together.
_ROWS, _CHARS = 64, 1 << 21
PROVIDER_KEYS = "anthropic google openai perplexity xai".split()


def number_links(text: str, urls: list[str | None]) -> tuple[str, dict[int, str]]:
    """Markdown links as [N]: a URL's first place among the annotations, new ones behind the last."""
    place: dict[str, int] = {}
    for i, url in enumerate(urls, 1):
        if url:
            place.setdefault(url, i)
    top = max(place.values(), default=0)

    def mark(m: re.Match) -> str:
        nonlocal top
        if m[2] not in place:
            top += 1
            place[m[2]] = top
        return f"[{place[m[2]]}]"

    out = _LINK.sub(mark, text)
    return out, {n: u for u, n in place.items()}


def unwrap_numbered(text: str) -> tuple[str, dict[int, str]]:
    """Links of the form [[n]](url) as [n]; a URL keeps its first n."""
    place: dict[str, int] = {}
    for m in _NUMBERED_LINK.finditer(text):
        place.setdefault(m[2], int(m[1]))
    return _NUMBERED_LINK.sub(lambda m: f"[{int(m[1])}]", text), {n: u for u, n in place.items()}


def marked_rows(text: str, urls: dict[int, str | None]) -> list[dict]:
    """A row for each marker with a URL; adjacent markers share the sentences before the first of them."""
    rows, end, begin, sentence = [], -1, 0, None
    for m in _MARK.finditer(text):
        if m.start() != end:
            begin, sentence = m.start(), None
        end = m.end()
        n = int(m[1])
        if url := (urls.get(n) or "").strip():
            if sentence is None:
                sentence = joined_sentences(text, stop=begin)
            rows.append({"url": url, "cited_sentence": sentence, "ord": n})
    return rows


def _inline(provider: str, text: str, annotated: list, numbered: dict[int, str]) -> list[dict]:
    if provider == "perplexity":
        return marked_rows(text, numbered)
    if provider == "xai":
        body, urls = unwrap_numbered(text)
        if urls:
            return marked_rows(body, urls)
    return marked_rows(*number_links(text, annotated))


def _cite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of keys and _text, _annotated, _numbers, _urls, _cited, _spoken, _order to one row a citation.

    Memory follows neither the batch nor the citations of a response: a few responses are read, and their rows sent on, at a time.
    """
    for b in (b.slice(k, _ROWS) for b in batches for k in range(0, b.num_rows, _ROWS)):
        at = {n: b.schema.get_field_index(n) for n in ("provider_key", *_SHAPED)}
        keys = [n for n in b.schema.names if n not in _SHAPED]
        owner, url, sentence, order = [], [], [], []

        def part() -> pa.RecordBatch:
            own = b.select(keys).take(pa.array(owner, pa.int64()))  # noqa: B023
            out = pa.RecordBatch.from_arrays([*own.columns, pa.array(url, pa.string()), pa.array(sentence, pa.string()), pa.array(order, pa.int32())], names=[*keys, "url", "cited_sentence", "ord"])  # noqa: B023
            for x in (owner, url, sentence, order):  # noqa: B023
                x.clear()
            return out

        row_bytes = b.select(keys).nbytes // b.num_rows
        size = 0
        for i, (provider, text, annotated, numbers, urls, cited, spoken, places) in enumerate(zip(*(b.column(at[n]).to_pylist() for n in ("provider_key", *_SHAPED)))):
            if provider in ("anthropic", "google"):
                known: dict[str, str] = {}
                found = []
                for u, t, o in zip(cited or (), spoken or (), places or ()):
                    if t not in known:
                        known[t] = joined_sentences(t)
                    found.append({"url": u, "cited_sentence": known[t], "ord": o})
            else:
                found = _inline(provider, text or "", annotated or [], dict(zip(numbers or (), urls or ())))
            for row in found:
                owner.append(i)
                url.append(row["url"])
                sentence.append(row["cited_sentence"])
                order.append(row["ord"])
                size += len(row["cited_sentence"]) + len(row["url"]) + row_bytes
                if size > _CHARS:
                    yield part()
                    size = 0
        yield part()


_SHAPED = ("_text", "_annotated", "_numbers", "_urls", "_cited", "_spoken", "_order")


def _numbered(meta: Column) -> Column:
    """number -> URL: the citations map, or else the search results by place."""
    results = F.coalesce(F.transform(meta["search_results"], lambda r: F.coalesce(r["url"], F.lit(""))), F.array().cast("array<string>"))
    places = F.transform(results, lambda _, i: i + 1)
    return F.when(F.size(meta["citations"]) > 0, meta["citations"]).otherwise(F.map_from_arrays(places, results))


def extract(responses: DataFrame) -> DataFrame:
    """provider_key, raw_response, meta (of type META) and keys, to one row a citation: keys, url, cited_sentence, ord.

    An unknown provider fails.  Rows of all providers may be mixed.
    """
    known = F.col("provider_key").isin(*PROVIDER_KEYS)
    checked = F.when(known, F.col("provider_key")).otherwise(F.raise_error(F.concat(F.lit("unknown provider: "), F.coalesce("provider_key", F.lit("null")))).cast("string"))
    lean(responses.sparkSession)
    rows = responses.withColumn("provider_key", checked)
    keys = [c for c in responses.columns if c not in ("raw_response", "meta")]
    meta = F.col("meta")

    # One pass over the responses: each becomes an array of what it cites, whatever its provider.
    is_ = lambda *names: F.col("provider_key").isin(*names)
    number = _numbered(meta)
    text = F.when(is_("perplexity"), strip_url_list("raw_response")).otherwise(F.col("raw_response"))
    inline = F.when(is_("openai", "xai", "perplexity"), text)
    annotated = F.transform(meta["annotations"], lambda a: a["url"])
    trimmed = lambda x: F.trim(F.coalesce(x, F.lit("")))
    spoken = lambda url, t, i: F.struct(url.alias("url"), F.coalesce(t, F.lit("")).alias("t"), (i + 1).cast("int").alias("ord"))
    native = F.transform(meta["native_citations"], lambda c, i: spoken(trimmed(c["url"]), c["cited_text"], i))
    chunks = F.transform(meta["grounding_chunks"], lambda c: trimmed(c["uri"]))
    each = F.flatten(F.transform(meta["grounding_supports"], lambda s: F.transform(F.coalesce(s["chunk_indices"], F.array().cast("array<int>")), lambda i: F.struct(s["text"].alias("t"), i.alias("k")))))
    support = F.transform(each, lambda p, i: spoken(F.when((p["k"] >= 0) & (p["k"] < F.size(chunks)), F.get(chunks, p["k"])).otherwise(F.lit("")), p["t"], i))
    native_or_support = F.filter(F.when(is_("anthropic"), native).when(is_("google"), support), lambda c: c["url"] != "")
    shaped = zip(_SHAPED, (inline, annotated, F.map_keys(number), F.map_values(number), native_or_support["url"], native_or_support["t"], native_or_support["ord"]))
    rows = rows.select(*keys, *(c.alias(n) for n, c in shaped))
    schema = T.StructType([*(f for f in rows.schema if f.name not in _SHAPED), T.StructField("url", T.StringType()), T.StructField("cited_sentence", T.StringType()), T.StructField("ord", T.IntegerType())])
    return rows.mapInArrow(_cite, schema)
