"""Static dimensions as literal tables: models, labels, orders, scoring matrices, sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .literal import literal

#: short name | full id | provider label | provider key | display name
_MODELS = """
claude-haiku|claude-haiku-4-5-20251001|Anthropic|anthropic|claude-haiku-4-5
claude-sonnet|claude-sonnet-4-6|Anthropic|anthropic|claude-sonnet-4-6
gemini-flash|gemini-3-flash-preview|Google|google|gemini-3-flash
gemini-pro|gemini-3.1-pro-preview|Google|google|gemini-3.1-pro
gpt-5|gpt-5-2025-08-07|OpenAI|openai|gpt-5
gpt-5-mini|gpt-5-mini-2025-08-07|OpenAI|openai|gpt-5-mini
grok-nr|grok-4-1-fast-non-reasoning|xAI|xai|grok-4.1-fast (NR)
grok-r|grok-4-1-fast-reasoning|xAI|xai|grok-4.1-fast (R)
sonar|sonar|Perplexity|perplexity|sonar
sonar-rp|sonar-reasoning-pro|Perplexity|perplexity|sonar-reasoning-pro
"""
MODELS = [tuple(x.split("|")) for x in _MODELS.split("\n") if x]
SHORT = [m[0] for m in MODELS]
PROVIDERS = "Anthropic OpenAI Perplexity Google xAI".split()
#: Pairs of models of one provider: the larger one, or the one that reasons, first.
SIZE_PAIRS = [tuple(x.split()) for x in ("Anthropic claude-sonnet claude-haiku", "OpenAI gpt-5 gpt-5-mini", "Google gemini-pro gemini-flash")]
REASONING_PAIRS = [tuple(x.split()) for x in ("xAI grok-r grok-nr", "Perplexity sonar-rp sonar")]

CATEGORIES = "Business|Culture & Recreation|Life & Arts|Professional|Science|Technology".split("|")
HIGH_STAKES = ("SD1", "SD2", "SD3")

#: code=label in display order
SOURCE_TYPES = dict(x.split("=") for x in "ST5=Blog/Social,ST6=Private Company,ST1=Official Institution,ST4=Wiki/Forum,ST3=News/Magazine,ST2=Paper/Research".split(","))
SOURCE_PURPOSES = dict(x.split("=") for x in "SP2=To Inform,SP3=To Instruct,SP5=To Discuss,SP1=To Promote,SP4=To Report,SP6=To Opine".split(","))
SOURCE_DOMAINS = dict(
    x.split("=") for x in "SD7=Technical,SD6=Code/Data,SD1=Medical/Health,SD5=Science,SD10=Everyday,SD3=Finance,SD2=Legal,SD8=Social/Professional,SD9=Shopping/Travel,SD4=Education".split(",")
)
#: best score first
SCORE_NAMES = {
    "asf": "Supported|Amplified|Contradicted|Misattributed|Fabricated".split("|"),
    "ssm": "Suitable|Adequate|Borderline|Inadequate|Unsuitable".split("|"),
    "ipam": "Structural Match|Functional Support|Partial Relevance|Weak Fit|Structural Conflict".split("|"),
}
AXIS_NAMES = {"asf": ("ASF (Fidelity)", "Answer-Source Fidelity", "FFR"), "ssm": ("SS (Suitability)", "Source Suitability", "SFR"), "ipam": ("IPA (Alignment)", "Intent-Purpose Alignment", "AFR")}

#: one row of scores for each intent QI1..QI5 (over SP1..SP6) and domain SD1..SD10 (over ST1..ST6)
_IPA = "153421 154332 235242 342333 232345"
_SS = "553112 553112 553223 553323 553322 443523 543323 444333 434433 434443"
IPA = [(f"QI{i + 1}", f"SP{j + 1}", int(s)) for i, row in enumerate(_IPA.split()) for j, s in enumerate(row)]
SS = [(f"SD{i + 1}", f"ST{j + 1}", int(s)) for i, row in enumerate(_SS.split()) for j, s in enumerate(row)]

#: variant, largest failing score of ipam, asf, ssm
THRESHOLDS = [(n, *map(int, t)) for n, t in (x.split(":") for x in "baseline:222 as_loose:232 as_strict:212 ipa_loose:322 ss_loose:223 ss_strict:221 ipa_strict:122".split())]

#: group of sites: slug=name
_SITES = {
    "Technology": "ai=Artificial Intelligence;dba=Database Administrators;security=Information Security;softwareengineering=Software Engineering;stackoverflow=Stack Overflow;stats=Cross Validated",
    "Science": "chemistry=Chemistry;earthscience=Earth Science;economics=Economics;physics=Physics;quant=Quantitative Finance",
    "Public": "aviation=Aviation;bicycles=Bicycles;cooking=Seasoned Advice;diy=Home Improvement;health=Medical Sciences;mechanics=Motor Vehicle Maintenance & Repair;outdoors=The Great Outdoors;parenting=Parenting;pets=Pets;travel=Travel",
    "Work": "academia=Academia;bitcoin=Bitcoin;law=Law;money=Personal Finance & Money;politics=Politics;skeptics=Skeptics;workplace=The Workplace",
}
SITES = [(*pair.split("="), domain) for domain, pairs in _SITES.items() for pair in pairs.split(";")]
_DOMAIN_OF = {key: domain for slug, name, domain in SITES for key in (slug, name)}


def site_domain(site: str) -> str:
    """The group of a site given by slug or by name; KeyError if unknown."""
    return _DOMAIN_OF[site]


def provider_of(model: str) -> str:
    """Provider label of a short name or full id; KeyError if unknown."""
    return next(m[2] for m in MODELS if model in m[:2]) if any(model in m[:2] for m in MODELS) else _unknown(model)


def _unknown(model: str) -> str:
    raise KeyError(f"no such model: {model!r}")


def models(spark: SparkSession) -> DataFrame:
    return literal(spark, [(i, *m) for i, m in enumerate(MODELS)], "ord int, model_short string, model string, provider string, provider_key string, display string")


def sites(spark: SparkSession) -> DataFrame:
    return literal(spark, [(k, d) for s, n, d in SITES for k in dict.fromkeys((s, n))], "site string, domain string")


def matrix(spark: SparkSession, which: str) -> DataFrame:
    """row_key, col_key, score: 30 cells of 'ipa', 60 of 'ss'."""
    return literal(spark, {"ipa": IPA, "ss": SS}[which], "row_key string, col_key string, score int")


def labels(spark: SparkSession) -> DataFrame:
    """ord, dimension, code, label, ymyl of the three source axes in display order."""
    rows, at = [], 0
    for dim, axis in (("Source Type", SOURCE_TYPES), ("Source Purpose", SOURCE_PURPOSES), ("Source Domain", SOURCE_DOMAINS)):
        for code, label in axis.items():
            rows.append((at, dim, code, label, "Y" if code in HIGH_STAKES else ""))
            at += 1
    return literal(spark, rows, "ord int, dimension string, code string, label string, ymyl string")
