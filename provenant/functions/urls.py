"""URL functions as native columns.

URLs are split by regular expressions, as Spark's parsers reject hosts and bytes
that occur in the wild.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query keys that start with one of these carry no content.
TRACKING = tuple("_hsenc _hsmi fbclid gclid mc_cid mc_eid msclkid utm_".split())
#: scheme, authority with its slashes, path with parameters, query, fragment
_PARTS = r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(//[^/?#]*)?([^?#]*)(?:\?([^#]*))?(?:#(?:.|\n)*)?$"

HOST_TIERS = [
    ("Academic", r"[.](edu|ac[.][a-z]{2,3})$"),
    ("Academic", r"^(www\.)?(arxiv|frontiersin|nature|nih|pubmed|science|sciencedirect|springer|wiley)\."),
    ("Gov/Org", r"\.gov(\.|$)|\.(org|int)$"),
    ("Forum/Q&A", r"(discourse|quora|reddit|stackexchange|stackoverflow|wikipedia)\."),
    ("Social/Blog", r"(blogspot|facebook|github\.io|instagram|linkedin|medium|substack|tiktok|tumblr|twitter|wordpress|x\.com|youtube)\."),
    ("News", r"(bbc|bloomberg|cnn|economist|forbes|nytimes|reuters|techcrunch|theguardian|washingtonpost|wsj)\."),
]
OTHER_TIER = "Commercial/Other"
_REDIRECTOR = "vertexaisearch.cloud.google.com"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, _PARTS, i)


def _decode(x: Column) -> Column:
    """Percent-decoding with plus as blank; what can't be decoded stays."""
    return F.coalesce(F.try_url_decode(x), F.replace(x, F.lit("+"), F.lit(" ")))


def _encode(x: Column) -> Column:
    """Form encoding that leaves ~ and escapes *."""
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normalise_url(url: Column | str) -> Column:
    """Tracking parameters and fragment dropped, the query re-encoded, the scheme lower-cased; path and host as they are."""
    url = _col(url)
    pairs = F.filter(F.split(_part(url, 4), "&"), lambda p: p != "")
    key = lambda p: _decode(F.regexp_extract(p, r"^([^=]*)", 1))
    tracked = lambda p: F.coalesce(*(F.when(F.startswith(key(p), F.lit(t)), F.lit(True)) for t in TRACKING), F.lit(False))
    kept = F.filter(pairs, lambda p: ~tracked(p))
    value = lambda p: F.regexp_extract(p, r"^[^=]*=?((?:.|\n)*)$", 1)
    query = F.array_join(F.transform(kept, lambda p: F.concat(_encode(key(p)), F.lit("="), _encode(_decode(value(p))))), "&")
    scheme = F.lower(_part(url, 1))
    return F.when(url.isNotNull(), F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), _part(url, 2), _part(url, 3), F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def url_id(url: Column | str) -> Column:
    """S and seven digits from the SHA-1 of the URL; not collision-free, see duplicates of it before joining."""
    n = F.conv(F.substring(F.sha1(_col(url).cast("binary")), 1, 14), 16, 10).cast("long") % 9_999_999 + 1
    return F.concat(F.lit("S"), F.lpad(n.cast("string"), 7, "0"))


def host(url: Column | str) -> Column:
    """Lower-case host name, '' without one."""
    authority = F.regexp_replace(_part(_col(url), 2), r"^//(?:[^@]*@)?", "")
    return F.when(_col(url).isNotNull(), F.lower(F.regexp_extract(authority, r"^(\[[^\]]*\]|[^:]*)", 1))).otherwise("")


def host_tier(url: Column | str, rules: list[tuple[str, str]] = HOST_TIERS) -> Column:
    """The tier of the first rule whose pattern the host holds."""
    h = host(url)
    out = None
    for tier, pattern in rules:
        out = F.when(h.rlike(pattern), tier) if out is None else out.when(h.rlike(pattern), tier)
    return out.otherwise(OTHER_TIER)


def is_grounding_redirect(url: Column | str) -> Column:
    """Whether the URL is a search provider's redirect that a fetcher should resolve."""
    return F.coalesce((host(url) == _REDIRECTOR) & _part(_col(url), 3).startswith("/grounding-api-redirect/"), F.lit(False))


def py_is_tracking(key: str) -> bool:
    return re.match("|".join(map(re.escape, TRACKING)), key) is not None
