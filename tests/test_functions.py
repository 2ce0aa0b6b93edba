import math
import random
from urllib.parse import parse_qsl, urlencode, urlparse, urlunparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenant.functions import extract as X
from provenant.functions import stats as S
from provenant.functions import text as T
from provenant.functions import urls as U
from provenant.functions.rounding import np_round
from provenant.operators import dims
from provenant.sources import io


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, x {kind}")
    return [r.y for r in df.select("i", make("x").alias("y")).orderBy("i").collect()]


URLS = {
    "HTTP://Ex.COM:80/A;p?utm_source=x&b=&a&c=1+2%20~*#f": "http://Ex.COM:80/A;p?b=&a=&c=1+2+~%2A",
    "http://e.com/?q=a%2Fb&&z": "http://e.com/?q=a%2Fb&z=",
    "http://e.com?utm_x=1": "http://e.com",
    "http://e.com/?": "http://e.com/",
    "http://e.com/?UTM_a=1&gclidX=2&=v": "http://e.com/?UTM_a=1&=v",
    "https://a_b.com/x|y?k=v|w#z": "https://a_b.com/x|y?k=v%7Cw",
}


def test_normalised_urls(spark):
    assert column(spark, [*URLS, None], U.normalise_url) == [*URLS.values(), None]


def test_normalised_urls_agree_with_the_standard_library(spark):
    rnd = random.Random(1)
    bits = ["a", "B=1", "utm_x=2", "x=%20", "y=a+b", "z=é", "&", "fbclid=1", "k=~*", "q=%C3%A9", "w=a=b", "mc_cid", "/", "."]
    urls = ["https://host.org/p" + "?" + "&".join(rnd.choice(bits) for _ in range(rnd.randint(0, 6))) + rnd.choice(["", "#f"]) for _ in range(200)]

    def want(u):
        p = urlparse(u)
        kept = filter(lambda kv: not kv[0].startswith(U.TRACKING), parse_qsl(p.query, True))
        return urlunparse((p[0], p[1], p[2], p[3], urlencode([*kept]), ""))

    assert column(spark, urls, U.normalise_url) == [want(u) for u in urls]


def test_url_ids_and_hosts(spark):
    import hashlib

    urls = [*URLS, "", "https://u:p@Host.ORG:8080/x", "mailto:a@b.c", "//x.y/z", "http://[::1]:80/"]
    want = [f"S{int(hashlib.sha1(u.encode()).hexdigest()[:14], 16) % 9999999 + 1:07d}" for u in urls]
    assert column(spark, urls, U.url_id) == want
    assert column(spark, urls[-5:], U.host) == ["", "host.org", "", "x.y", "[::1]"]


@pytest.mark.parametrize(
    "host,tier",
    [
        ("mit.edu", "Academic"), ("x.ac.uk", "Academic"), ("arxiv.org", "Academic"), ("www.nature.com", "Academic"), ("en.wikipedia.org", "Gov/Org"), ("nasa.gov", "Gov/Org"),
        ("a.gov.uk", "Gov/Org"), ("who.int", "Gov/Org"), ("old.reddit.com", "Forum/Q&A"), ("stackoverflow.com", "Forum/Q&A"), ("medium.com", "Social/Blog"), ("x.com", "Commercial/Other"),
        ("a.github.io", "Commercial/Other"), ("abcnn.com", "News"), ("bbc.co.uk", "News"), ("shop.com", "Commercial/Other"), ("", "Commercial/Other"),
    ],
)
def test_host_tiers(spark, host, tier):
    assert column(spark, [f"https://{host}/p" if host else "nothing"], U.host_tier) == [tier]


def test_redirects(spark):
    urls = ["https://vertexaisearch.cloud.google.com/grounding-api-redirect/abc", "https://vertexaisearch.cloud.google.com/other", "https://x.com/grounding-api-redirect/", None]
    assert column(spark, urls, U.is_grounding_redirect) == [True, False, False, False]


def test_small_text_functions(spark):
    assert column(spark, ["a  b c\n", "", "  ", None], T.word_count)[:3] == [3, 0, 0]
    assert column(spark, [" a\n\n\n\nb\n\nc \n", "\n\n\n"], T.collapse_newlines) == ["a\n\nb\n\nc", ""]
    assert column(spark, ["body [1]\n[1] https://a\n[2] https://b", "no list [1]"], T.strip_url_list) == ["body [1]", "no list [1]"]
    assert column(spark, ["ASF1", "ASF5", None], T.asf_score) == [1, 5, None]
    assert column(spark, ["x" * 10], lambda c: T.truncate(c, 4)) == ["xxxx"]
    with pytest.raises(Exception, match="no such label"):
        column(spark, ["SP1"], T.asf_score)
    assert column(spark, [0.0, 0.01, 0.06, 0.14, math.nan, None], T.effect_size, "double") == ["negligible", "small", "medium", "large", "", ""]
    assert column(spark, ["q"], lambda c: T.tagged(question=F.col(c))) == ["<question>\nq\n</question>"]


@pytest.mark.parametrize(
    "text,want",
    [
        ("One. Two. Three.", ["Two.", "Three."]),
        ("One. Two! Three", ["Two!", "Three"]),
        ("See e.g. this. And that", ["See e.g. this.", "And that"]),
        ("At https://a.b/c.d now. Then", ["At https://a.b/c.d now.", "Then"]),
        ("Intro\n- item one\n- item two", ["- item one", "- item two"]),
        ("Head\n\nBody text", ["Head", "Body text"]),
        ("Value 3.5 is", ["Value 3.", "5 is"]),
        ("[1] [2] First. Second", ["First.", "Second"]),
        ("**Bold.** “Quote”", ["Bold.", "Quote"]),
        ("", []),
        (None, []),
        ("...", [".", "."]),
        ("1. one\n2. two\n### head", ["two", "### head"]),
    ],
)
def test_last_sentences(text, want):
    assert T.last_sentences(text) == want


def test_link_numbers():
    assert X.number_links("a [x](https://a) b [y](https://c) [z](https://b)", ["https://b", "", "https://b", "https://a"]) == ("a [4] b [5] [1]", {1: "https://b", 4: "https://a", 5: "https://c"})
    assert X.unwrap_numbered("p [[3]](https://a)[[4]](https://a)") == ("p [3][4]", {3: "https://a"})
    rows = X.marked_rows("One. Two [1][2]. Three [9] four [1]", {1: "https://a", 2: " "})
    assert [(r["url"], r["ord"]) for r in rows] == [("https://a", 1), ("https://a", 1)]
    assert rows[0]["cited_sentence"] == "One. Two" and rows[1]["cited_sentence"].endswith("four")


def test_extraction_by_provider(spark):
    meta = {"annotations": [("https://a", "t", 0, 1)], "citations": None, "search_results": None, "native_citations": None, "grounding_chunks": None, "grounding_supports": None}
    rows = [
        (1, "openai", "First. Said [x](https://b). End [y](https://a)", meta),
        (2, "xai", "Said [[2]](https://z) well", meta),
        (3, "xai", "Said [q](https://a) well", meta),
        (4, "perplexity", "Alpha. Beta [1][2]\n[1] https://x", {**meta, "citations": {1: "https://one", 2: ""}}),
        (5, "perplexity", "Alpha. Beta [2]", {**meta, "search_results": [("https://r1",), ("https://r2",)]}),
        (6, "anthropic", "x", {**meta, "native_citations": [("A. B. C", "https://n"), ("t", " ")]}),
        (7, "google", "x", {**meta, "grounding_chunks": [("t", "https://g"), ("t", None)], "grounding_supports": [([0, 1], "S one"), ([-1, 0, 5], "S two")]}),
        (8, "google", None, None),
        (9, "openai", None, None),
    ]
    df = spark.createDataFrame(rows, f"id int, provider_key string, raw_response string, meta {X.META}")
    got = sorted((r.id, r.url, r.ord, r.cited_sentence) for r in X.extract(df).collect())
    assert got == [
        (1, "https://a", 1, "Said [2]. End"), (1, "https://b", 2, "First. Said"), (2, "https://z", 2, "Said"), (3, "https://a", 1, "Said"),
        (4, "https://one", 1, "Alpha. Beta"), (5, "https://r2", 2, "Alpha. Beta"), (6, "https://n", 1, "B. C"), (7, "https://g", 1, "S one"), (7, "https://g", 4, "S two"),
    ]
    with pytest.raises(Exception, match="unknown provider"):
        X.extract(df.withColumn("provider_key", F.lit("other"))).collect()


def test_rounding(spark):
    values = [2.675, 0.125, 1.005, -0.5, 2.5, 1e9 + 0.5]
    assert column(spark, values, lambda c: np_round(c, 2), "double") == [float(np.round(v, 2)) for v in values]
    assert [io.np_round(v, d) for v in values for d in (0, 1, 2)] == [float(np.round(v, d)) for v in values for d in (0, 1, 2)]


# -- statistics against NumPy


def test_kruskal(spark):
    rng = np.random.default_rng(3)
    groups = [rng.integers(1, 6, n) + (i == 1) for i, n in enumerate((30, 40, 50))]
    rows = [("a", f"g{i}", int(s), 1) for i, g in enumerate(groups) for s in g] + [("b", "g0", 1, 5), ("c", "g0", 1, 2), ("c", "g1", 1, 2), ("a", None, 3, 9)]
    got = {r.axis: r for r in S.kruskal(spark.createDataFrame(rows, "axis string, grp string, score int, c long"), ["axis"]).collect()}
    every = np.concatenate(groups)
    order = np.sort(every)
    rank = {s: (np.searchsorted(order, s) + np.searchsorted(order, s, "right") + 1) / 2 for s in np.unique(every)}
    n = len(every)
    h = 12 / (n * (n + 1)) * sum(sum(rank[s] for s in g) ** 2 / len(g) for g in groups) - 3 * (n + 1)
    t = np.unique(every, return_counts=True)[1].astype(float)
    assert math.isclose(got["a"].h, h / (1 - (t**3 - t).sum() / (n**3 - n)), rel_tol=1e-12) and got["a"].k == 3
    assert math.isnan(got["b"].h) and math.isnan(got["c"].h)


def test_kendall(spark):
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 5, 9) / 4, rng.integers(0, 5, 9) / 4
    rows = [("v", f"k{i}", float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))] + [("w", "a", 1.0, 2.0), ("w", "b", 1.0, 3.0), ("u", "a", 1.0, 1.0)]
    got = {r.v: r.tau for r in S.kendall(spark.createDataFrame(rows, "v string, k string, x double, y double"), ["v"], "k", "x", "y").collect()}
    sx, sy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    assert math.isclose(got["v"], (sx * sy).sum() / math.sqrt(abs(sx).sum() * abs(sy).sum()))
    assert math.isnan(got["w"]) and math.isnan(got["u"])


def test_majority(spark):
    votes = [["b", "a", "a"], ["a", "b", "c"], ["a", "b", "b", "a"], ["z"]]
    assert column(spark, votes, lambda c: S.majority(F.col(c)), "array<string>") == ["a", "a", "a", "z"]


def test_kappas(spark):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 3, 200), rng.integers(0, 3, 200)
    b[:120] = a[:120]
    rows = [("t", str(x), str(y), 1) for x, y in zip(a, b)] + [("one", "x", "x", 4)]
    cells = spark.createDataFrame(rows, "task string, a string, b string, c long")
    got = {r.task: r for r in S.kappa(cells, ["task"]).collect()}
    po, pe = (a == b).mean(), sum((a == c).mean() * (b == c).mean() for c in range(3))
    assert math.isclose(got["t"].kappa, (po - pe) / (1 - pe)) and math.isclose(got["t"].agreement, po) and math.isnan(got["one"].kappa)
    acc = {r.task: r.bal_acc for r in S.balanced_accuracy(cells, ["task"]).collect()}
    assert math.isclose(acc["t"], np.mean([(b[a == c] == c).mean() for c in range(3)]))
    ci = {r.task: r for r in S.bootstrap_kappa(cells.where("task = 't'"), "task").collect()}["t"]
    draws = [rng.integers(0, 200, 200) for _ in range(1000)]
    k = [((a[i] == b[i]).mean() - (e := sum((a[i] == c).mean() * (b[i] == c).mean() for c in range(3)))) / (1 - e) for i in draws]
    assert abs(ci.lo - np.quantile(k, 0.025)) < 0.02 and abs(ci.hi - np.quantile(k, 0.975)) < 0.02
    again = {r.task: r for r in S.bootstrap_kappa(cells.where("task = 't'").repartition(3), "task").collect()}["t"]
    assert (again.lo, again.hi) == (ci.lo, ci.hi)


def test_icc(spark):
    arr = np.random.default_rng(6).integers(1, 6, (12, 5)) + np.arange(12)[:, None] // 3
    rows = [("g", str(i), j, int(x)) for i, r in enumerate(arr) for j, x in enumerate(r)]
    r = S.icc(spark.createDataFrame(rows, "grp string, cell string, rater int, score int"), ["grp"]).first()
    n, k = arr.shape
    g = arr.mean()
    msr, msc = k * ((arr.mean(1) - g) ** 2).sum() / (n - 1), n * ((arr.mean(0) - g) ** 2).sum() / (k - 1)
    mse = ((arr - arr.mean(1, keepdims=True) - arr.mean(0, keepdims=True) + g) ** 2).sum() / ((n - 1) * (k - 1))
    assert np.allclose([r.msr, r.msc, r.mse, r.icc], [msr, msc, mse, (msr - mse) / (msc / n + msr - mse / n)])
    lo, hi = S.icc_interval(r.msr, r.msc, r.mse, n, k)
    assert lo < r.icc < hi and math.isnan(S.icc_interval(1, 1, 0, 3, 3)[0])
    with pytest.raises(Exception, match="different numbers"):
        S.icc(spark.createDataFrame(rows[:-1], "grp string, cell string, rater int, score int"), ["grp"]).collect()


def test_f_quantiles(spark):
    jvm = spark.sparkContext._jvm
    for d1, d2 in ((29, 261), (261, 29), (5, 45), (59, 531), (1, 1)):
        want = jvm.org.apache.commons.math3.distribution.FDistribution(float(d1), float(d2)).inverseCumulativeProbability(0.975)
        assert math.isclose(S.f_quantile(0.975, d1, d2), want, rel_tol=1e-6)


def test_pearson(spark):
    x, y = [1, 2, 3, 5, 8], [2, 1, 4, 4, 9]
    rows = [("g", a, b) for a, b in zip(x, y)] + [("h", 1, 1), ("i", 1, 2), ("i", 1, 3)]
    got = {r.grp: r.r for r in S.pearson(spark.createDataFrame(rows, "grp string, x long, y long"), ["grp"], "x", "y").collect()}
    assert math.isclose(got["g"], np.corrcoef(x, y)[0, 1]) and math.isnan(got["h"]) and math.isnan(got["i"])


def test_dimensions(spark):
    assert len(dims.MODELS) == 10 and len(dims.IPA) == 30 and len(dims.SS) == 60 and len(dims.SITES) == 28
    assert dims.site_domain("law") == dims.site_domain("Law") == "Work" and dims.provider_of("gpt-5-2025-08-07") == "OpenAI"
    for f in (dims.site_domain, dims.provider_of):
        with pytest.raises(KeyError):
            f("none")
    assert dims.models(spark).count() == 10 and dims.labels(spark).count() == 22


def test_citations_are_sent_on_in_parts():
    import pyarrow as pa

    from provenant.functions import extract as X

    text = "It is so. " * 40 + "".join(f"Said {i}. [x](http://e.example/{i}) " for i in range(100))
    n = 150
    shaped = {"_text": [text] * n, "_annotated": [[]] * n, "_numbers": [None] * n, "_urls": [None] * n, "_cited": [None] * n, "_spoken": [None] * n, "_order": [None] * n}
    batch = pa.RecordBatch.from_pydict({"id": [*range(n)], "key": ["k" * 10_000] * n, "provider_key": ["openai"] * n, **shaped})
    parts = [*X._cite(iter([batch]))]
    assert sum(p.num_rows for p in parts) == n * 100
    assert max(p.nbytes for p in parts) < 8e6 < batch.nbytes * 10
    rows = [r for p in parts for r in p.select(["id", "url", "ord"]).to_pylist()]
    assert rows == [{"id": i, "url": f"http://e.example/{k}", "ord": k + 1} for i in range(n) for k in range(100)]
