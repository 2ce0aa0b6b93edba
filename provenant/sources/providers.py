"""Recorded replies of the five providers, as JSON, to response text and citation metadata.

Columns only: each provider's reply is read with its own schema and shaped into the
metadata that `functions.extract` takes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.extract import META

_PLACE = "url:string,title:string,start_index:int,end_index:int"
_RESPONSES = f"struct<output:array<struct<type:string,content:array<struct<type:string,text:string,annotations:array<struct<type:string,{_PLACE},url_citation:struct<{_PLACE}>,web_citation:struct<{_PLACE}>>>>>>>,output_text:string>"
_SCHEMAS = {
    "openai": _RESPONSES,
    "xai": _RESPONSES,
    "perplexity": "struct<choices:array<struct<message:struct<content:string>>>,citations:array<string>,search_results:array<struct<url:string>>>",
    "anthropic": "struct<content:array<struct<type:string,text:string,citations:array<struct<cited_text:string,url:string>>>>>",
    "google": "struct<text:string,candidates:array<struct<grounding_metadata:struct<grounding_chunks:array<struct<web:struct<title:string,uri:string>>>,grounding_supports:array<struct<segment:struct<text:string>,grounding_chunk_indices:array<int>>>>>>>",
}
_FIELDS = [f.split(":")[0] for f in ("annotations", "citations", "search_results", "native_citations", "grounding_chunks", "grounding_supports")]


def _strip(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")


def _all(items: Column) -> Column:
    """An array, empty instead of null."""
    return F.filter(items, lambda x: x.isNotNull())


def _meta(**fields: Column) -> Column:
    return F.struct(*((fields[f] if f in fields else F.lit(None)).alias(f) for f in _FIELDS)).cast(META)


def _block_style(got: Column, nested: tuple[str, ...], only: str | None) -> tuple[Column, Column]:
    """openai and xai: texts and annotations of content blocks; an annotation's place is flat or nested."""
    blocks = F.flatten(_all(F.transform(got["output"], lambda o: o["content"])))
    said = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "")
    text = F.when(_strip(said) != "", _strip(said)).otherwise(_strip(got["output_text"]))
    notes = F.flatten(_all(F.transform(blocks, lambda b: b["annotations"])))
    if only:
        notes = F.filter(notes, lambda a: a["type"] == only)
    pick = lambda a, f: F.when(F.coalesce(*(a[n] for n in nested)).isNotNull(), F.coalesce(*(a[n] for n in nested))[f]).otherwise(a[f])
    places = F.transform(notes, lambda a: F.struct(*(pick(a, f).alias(f) for f in ("url", "title", "start_index", "end_index"))))
    return text, places if only else F.filter(places, lambda a: F.coalesce(a["url"], F.lit("")) != "")


def shaped(provider_key: Column | str, reply: Column | str) -> Column:
    """raw_response and meta of a recorded reply; null where the provider is unknown, or has to answer with text and hasn't."""
    key = F.col(provider_key) if isinstance(provider_key, str) else provider_key
    reply = F.col(reply) if isinstance(reply, str) else reply
    got = {p: F.from_json(reply, s) for p, s in _SCHEMAS.items()}
    out = {}
    for p, nested, only in (("openai", ("url_citation",), "url_citation"), ("xai", ("url_citation", "web_citation"), None)):
        text, places = _block_style(got[p], nested, only)
        out[p] = text, _meta(annotations=places), F.lit(True)
    g = got["perplexity"]
    text = _strip(F.get(g["choices"], F.lit(0))["message"]["content"])
    numbers = F.transform(g["citations"], lambda _, i: i + 1)
    out["perplexity"] = text, _meta(citations=F.map_from_arrays(numbers, g["citations"]), search_results=g["search_results"]), text != ""
    blocks = F.filter(got["anthropic"]["content"], lambda b: b["type"] == "text")
    cited = F.flatten(_all(F.transform(blocks, lambda b: b["citations"])))
    out["anthropic"] = _strip(F.array_join(F.transform(blocks, lambda b: F.coalesce(b["text"], F.lit(""))), "\n")), _meta(native_citations=cited), F.lit(True)
    g = got["google"]
    text, ground = _strip(g["text"]), F.get(g["candidates"], F.lit(0))["grounding_metadata"]
    chunks = F.transform(F.filter(ground["grounding_chunks"], lambda c: c["web"].isNotNull()), lambda c: c["web"])
    supports = F.transform(ground["grounding_supports"], lambda s: F.struct(s["grounding_chunk_indices"].alias("chunk_indices"), F.coalesce(s["segment"]["text"], F.lit("")).alias("text")))
    out["google"] = text, _meta(grounding_chunks=chunks, grounding_supports=supports), text != ""
    result = None
    for p, (text, meta, good) in out.items():
        case = (key == p) & good
        value = F.struct(text.alias("raw_response"), meta.alias("meta"))
        result = F.when(case, value) if result is None else result.when(case, value)
    return result
