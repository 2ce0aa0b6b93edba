"""Personal data: patterns propose spans, checksums confirm, context adjusts.

Base kinds (email, ip, card, phone) follow fixed patterns, leftmost and
non-overlapping per kind; a match that fails its test is dropped and not
retried.  The scoring layer adds further spans and never takes a base span away:

* ``iban``: country code, two check digits and as many characters, in groups or
  not, as the country's numbers have, confirmed by the remainder 1 modulo 97;
* ``card13``: 13 digits that pass Luhn, only with a card word nearby;
* ``tel``: national numbers of 9 to 11 digits, only with a telephone word nearby.

Defined cases: a null text has no spans, an empty text neither; repeated rows
give repeated results; extra columns are ignored unless named in `keep`;
an empty table gives an empty result.  Texts are searched whole; every pattern
takes time linear in the text, and added spans are held against base spans by
bisection.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import lean

KINDS = ("email", "ip", "card", "phone", "iban", "card13", "tel")
BASE = KINDS[:4]
_ORDER = {k: i for i, k in enumerate(KINDS)}
#: Characters on either side in which context words count.
CONTEXT_CHARS = 48
THRESHOLD = 0.5

_LOCAL_TAIL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGIT = re.compile(r"[0-9]")
# The look-behinds keep a failing run of digits from being tried at each digit.
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"[A-Z](?<![A-Za-z0-9][A-Z])[A-Z][0-9]{2}")
#: Characters of an IBAN by country, after the public registry.
_IBAN_LENGTH = {
    k: n
    for n, names in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD MN PK RO SA SE SK TN VG YE", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for k in names.split()
}
_IBAN_REST = {n: re.compile(rf"(?: ?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in {*_IBAN_LENGTH.values()}}
_TEL = re.compile(r"[0-9(](?<![0-9+.][0-9(])(?:[ ./()-]{0,2}[0-9]){8,10}+(?![0-9])")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_CARD_WORDS = re.compile(r"\b(?:card|visa|mastercard|amex|credit|debit|carte|karte|tarjeta)\b", re.I)
_TEL_WORDS = re.compile(r"\b(?:tel|telephone|phone|mobile|call|fax|telefon|téléphone|teléfono|handy)\b", re.I)
_BANK_WORDS = re.compile(r"\b(?:iban|bank|account|konto|compte|cuenta)\b", re.I)
_MAIL_WORDS = re.compile(r"\b(?:e-?mail|contact|write|mailto)\b", re.I)
_CONTEXT = {"email": _MAIL_WORDS, "card": _CARD_WORDS, "card13": _CARD_WORDS, "phone": _TEL_WORDS, "tel": _TEL_WORDS, "iban": _BANK_WORDS}
#: Score of a confirmed pattern before context; context adds 0.3.
_PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.9, "card13": 0.3, "tel": 0.3}

Span = tuple[str, int, int, float]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban[4:] + iban[:4]
    rest = 0
    for c in s:
        v = int(c, 36)
        rest = (rest * (100 if v > 9 else 10) + v) % 97
    return rest == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    floor = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL_TAIL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            floor = m.end()
        at = text.find("@", max(floor, at + 1))


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        size = _IBAN_LENGTH.get(m.group()[:2])
        rest = _IBAN_REST[size].match(text, m.end()) if size else None
        if rest and mod97(text[m.start() : rest.end()].replace(" ", "")):
            yield m.start(), rest.end()


def _free(taken: list[tuple[int, int]]):
    """Whether a span overlaps none of those taken."""
    joined: list[list[int]] = []
    for s, e in sorted(taken):
        if joined and s <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], e)
        else:
            joined.append([s, e])
    starts = [x[0] for x in joined]

    def test(s: int, e: int) -> bool:
        i = bisect_left(starts, e) - 1
        return i < 0 or joined[i][1] <= s

    return test


def _score(kind: str, text: str, start: int, end: int) -> float:
    words = _CONTEXT.get(kind)
    near = words is not None and bool(words.search(text[max(0, start - CONTEXT_CHARS) : start]) or words.search(text[end : end + CONTEXT_CHARS]))
    return min(1.0, _PRIOR[kind] + 0.3 * near)


def find_spans(text: str | None) -> list[Span]:
    """All (kind, start, end, score), by start, then kind."""
    if not text:
        return []
    found: list[tuple[str, int, int]] = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p := x.lstrip("0")) < 4 and int(p or "0") <= 255 for x in m.group().split(".")):
                found.append(("ip", m.start(), m.end()))
        card13 = []
        for m in _CARD.finditer(text):
            if m.end() - m.start() < 13:
                continue
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
            elif len(digits) == 13 and luhn(digits):
                card13.append(("card13", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                    found.append(("phone", m.start(), m.end()))
        extra = card13
        extra += [("iban", *x) for x in _ibans(text)]
        if _TEL_WORDS.search(text):
            extra += [("tel", *m.span()) for m in _TEL.finditer(text)]
        free = _free([(s, e) for _, s, e in found])
        found += [(kind, s, e) for kind, s, e in extra if free(s, e) and _score(kind, text, s, e) >= THRESHOLD]
    found.sort(key=lambda x: (x[1], _ORDER[x[0]]))
    return [(k, s, e, _score(k, text, s, e)) for k, s, e in found]


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span, overlapping ones merged, as its kind in brackets."""
    out, at = [], 0
    for kind, start, end, _ in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))])
    for b in batches:
        out = [[{"kind": k, "start": s, "end": e, "score": p} for k, s, e, p in find_spans(t.as_py())] for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, schema.field(1).type)], schema=schema)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans array<struct<kind, start, end, score>>: one row for each input row."""
    lean(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scan, "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>")


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = b.schema.get_field_index("text")
        texts = [None if t is None else redact(t, find_spans(t)) for t in b.column(at).to_pylist()]
        yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))


def redact_documents(docs: DataFrame) -> DataFrame:
    """The same rows and columns; spans in `text` masked, `n_chars` (if there) recounted."""
    lean(docs.sparkSession)
    out = docs.mapInArrow(_redact, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", *(f"n_{k}" for k in BASE), "n_added", "base_sha256", "spans", "top_score"]
    for b in batches:
        cols: list[list] = [[] for _ in names[1:]]
        for t in b.column(1).to_pylist():
            spans = find_spans(t)
            base = ",".join(f"{k}:{s}:{e}" for k, s, e, _ in spans if k in BASE)
            row = [*(sum(x[0] == k for x in spans) for k in BASE), sum(x[0] not in BASE for x in spans), hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{k}:{s}:{e}" for k, s, e, _ in spans), max((x[3] for x in spans), default=0.0)]
            for c, v in zip(cols, row):
                c.append(v)
        kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)


def digest(docs: DataFrame) -> DataFrame:
    lean(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_digest, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string, top_score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
