"""Text functions: native columns, and Arrow UDFs where sentences are scanned."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CRAWL_CAP, JUDGE_CAP = 50_000, 30_000
SENTENCES = 2
#: Characters stripped around a sentence: blanks, emphasis, quotes, parentheses.
CHROME = " \t\n" + "*`()" + "\"'" + "“”‘’"
_SHORT_FORMS = sorted("e.g. i.e. etc. dr. mr. mrs. ms. u.s. u.k. vs.".split())
#: Characters at the end of a text that are searched first.
_WINDOW = 1024
_URL = re.compile(r"http(?:s|)://[^])\s]+")
_LEADING_MARK = re.compile(r"\s*\[\d+]\s*")
_LIST_ITEM = re.compile(r"\d+[.]\s")


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def word_count(text: Column | str) -> Column:
    """Words between Unicode white space."""
    return F.size(F.filter(F.split(_col(text), r"(?U)\s+"), lambda w: w != ""))


def collapse_newlines(text: Column | str) -> Column:
    """Three or more line ends become two; white space around goes."""
    return F.regexp_replace(F.regexp_replace(_col(text), r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def truncate(text: Column | str, cap: int) -> Column:
    return F.substring(_col(text), 1, cap)


def strip_url_list(text: Column | str) -> Column:
    """The text before a trailing list of numbered URLs."""
    return F.split(_col(text), r"\n\s*[\[]\d+[\]]\s+http(?:s|)://", 2)[0]


def asf_score(label: Column | str) -> Column:
    """The number of an ASF label; anything else fails."""
    label = _col(label)
    number = F.when(label.startswith("ASF"), F.substring(label, 4, 9).try_cast("int"))
    return F.when(label.isNull(), F.lit(None).cast("int")).otherwise(F.coalesce(number, F.raise_error(F.concat(F.lit("no such label: "), label)).cast("int")))


def effect_size(eta: Column | str) -> Column:
    eta = _col(eta)
    return F.when(eta.isNull() | F.isnan(eta), "").when(eta < 0.01, "negligible").when(eta < 0.06, "small").when(eta < 0.14, "medium").otherwise("large")


# -- prompts


def tagged(**parts: Column) -> Column:
    """Each part between tags of its name, in order: the user message of a judge."""
    pieces: list[Column] = []
    for name, value in parts.items():
        pieces += [F.lit(f"{'' if not pieces else chr(10)}<{name}>\n"), F.coalesce(value, F.lit("")), F.lit(f"\n</{name}>")]
    return F.concat(*pieces)


# -- sentences


def _ends_short_form(lower: str, dot: int) -> bool:
    for form in _SHORT_FORMS:
        k = form.find(".")
        while k >= 0:
            if dot >= k and lower.startswith(form, dot - k):
                return True
            k = form.find(".", k + 1)
    return False


def _new_block(text: str, at: int) -> int:
    """Characters of the line end at `at` if a paragraph, list item or heading starts behind it, else 0."""
    if text[at] != "\n":
        return 0
    if text.startswith("\n", at + 1):
        return 2
    ahead = text[at + 1 :].lstrip(" \t")[:4] if len(text) - at < 64 else _ahead(text, at + 1)
    return int(ahead.startswith(("- ", "* ", "### ")) or _LIST_ITEM.match(ahead) is not None)


def _ahead(text: str, at: int) -> str:
    while at < len(text) and text[at] in " \t":
        at += 1
    return text[at : at + 4]


def clean_sentence(piece: str) -> str:
    piece = piece.strip(CHROME)
    while m := _LEADING_MARK.match(piece):
        piece = piece[m.end() :]
    return piece.strip(CHROME)


def last_sentences(text: str | None, n: int = SENTENCES, stop: int | None = None) -> list[str]:
    """The last n sentences (before stop), found from the right; the final terminator is no boundary.

    Only the end of a long text is looked at, from a blank on (no URL or short form
    goes across one), and more of it if there are too few boundaries; no more is copied.
    """
    text = text or ""
    end = len(text) if stop is None else stop
    while end and (text[end - 1].isspace() or text[end - 1] in CHROME):
        end -= 1
    size = _WINDOW
    while size < end:
        blank = max(text.rfind(c, 0, end - size) for c in " \n")
        if blank <= 0:
            break
        found = _sentences(text[blank:end], n)
        if found is not None:
            return found
        size *= 4
    return _sentences(text[:end], n, True) or []


def _sentences(text: str, n: int, whole: bool = False) -> list[str] | None:
    """The sentences, or None if a part of a text has fewer than n boundaries."""
    if not text:
        return []
    urls = [m.span() for m in _URL.finditer(text)]
    lower, cuts, at = text.lower(), [len(text)], len(text) - 2
    if len(lower) != len(text):  # some characters change length; keep positions
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    while at >= 0 and len(cuts) <= n:
        c = text[at]
        if c in ".!?":
            while urls and urls[-1][0] > at:
                urls.pop()
            in_url = bool(urls) and urls[-1][0] <= at < urls[-1][1]
            if not in_url and not (c == "." and _ends_short_form(lower, at)):
                cuts.append(at + 1)
        elif c == "\n" and (step := _new_block(text, at)):
            cuts.append(at + step)
        at -= 1
    if len(cuts) <= n:
        if not whole:
            return None
        cuts.append(0)
    pieces = [clean_sentence(text[a:b]) for b, a in zip(cuts, cuts[1:])]
    return [p for p in reversed(pieces) if p]


def joined_sentences(text: str | None, n: int = SENTENCES, stop: int | None = None) -> str:
    return " ".join(last_sentences(text, n, stop)).strip()


@F.pandas_udf(T.StringType())
def cited_sentence(text: pd.Series) -> pd.Series:
    return text.map(joined_sentences)
