"""op2 and op6 against brute force."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from provenant.llm import op2_topk, op6_mixing

INF, NAN = float("inf"), float("nan")


def brute2(rows, k):
    good = [(i, [math.floor(1024.0 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in sorted(good):
        if i % 100 == 0:
            queries.setdefault(i, v)
    out = []
    for q, v in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("bins,block,cells", [(op2_topk.BINS, op2_topk.BLOCK, op2_topk.CELLS), (4, 3, 7)])
def test_topk(spark, monkeypatch, bins, block, cells):
    monkeypatch.setattr(op2_topk, "BINS", bins)
    monkeypatch.setattr(op2_topk, "BLOCK", block)
    monkeypatch.setattr(op2_topk, "CELLS", cells)
    rng = np.random.default_rng(4)
    values = lambda n: [float(np.float32(x)) for x in rng.integers(-3, 4, n) / 4]  # noqa: E731  many ties
    rows = [(i, values(6)) for i in range(450)]
    rows += [(0, values(6)), (100, rows[100][1]), (7, rows[7][1]), (None, values(6)), (500, None), (600, [None] * 6), (700, [NAN] * 6), (701, [1.0, INF, 0.0, 0.0, 0.0, 0.0]), (800, values(3)), (801, values(3)), (900, []), (901, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string").repartition(4)
    got = sorted(tuple(r) for r in op2_topk.top_k(df, df.where("vec_id % 100 = 0"), 10).collect())
    assert got == brute2(rows, 10)


def test_topk_of_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [0.5]), (1, [0.25]), (2, [0.25])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in op2_topk.top_k(df, df.where("vec_id = 0"), 10).orderBy("rank").collect()] == [(0, 1, 1, 512 * 256), (0, 2, 2, 512 * 256)]
    assert op2_topk.top_k(df.limit(0), df.limit(0)).count() == 0
    assert op2_topk.top_k(df.where("vec_id = 0"), df.where("vec_id = 0")).count() == 0


def test_topk_of_large_components(spark):
    df = spark.createDataFrame([(0, [1e5, -1e5]), (1, [1e5 + 0.5, 3.0]), (2, [-7e4, 1e5])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in op2_topk.top_k(df, df.where("vec_id = 0")).collect())
    assert got == brute2([(r.vec_id, r.embedding) for r in df.collect()], 10)


def test_power_meets_the_limit_and_the_entropy():
    shares = [0.7, 0.2, 0.1]
    power = op6_mixing.bisect(shares, 2.0)
    per = [w / s for w, s in zip(op6_mixing.shares_to(shares, power), shares)]
    assert abs(max(per) / min(per) - 2.0) < 1e-6
    power = op6_mixing.bisect(shares, None, 0.9)
    assert abs(op6_mixing.entropy(op6_mixing.shares_to(shares, power)) - 0.9) < 1e-6
    assert op6_mixing.bisect(shares, 100.0) == 0.0 and op6_mixing.bisect([], 2.0) == 0.0


def test_targets_that_cannot_be_met_are_errors():
    shares = [0.7, 0.2, 0.1]
    for target in (op6_mixing.entropy(shares) - 0.01, math.log(3) + 0.01):
        with pytest.raises(ValueError, match="entropy"):
            op6_mixing.bisect(shares, None, target)
    assert op6_mixing.bisect(shares, None, math.log(3)) == 0.0
    with pytest.raises(ValueError, match="limit"):
        op6_mixing.bisect(shares, 1.5, math.log(3))
    with pytest.raises(ValueError, match="budget"):
        op6_mixing.plan({"a": 70, "b": 30}, 2.0, budget=300)
    tokens = {"a": 700, "b": 200, "c": 100}
    mixed = op6_mixing.plan(tokens, 3.0, budget=2000)
    assert abs(max(mixed.repeats.values()) - 3.0) < 1e-6 and abs(sum(mixed.repeats[s] * n for s, n in tokens.items()) - 2000) < 1e-6


def test_mix_reads_every_document_and_keeps_to_quotas(spark, docs, rows):
    import re

    tokens = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _, _ in rows}
    size = defaultdict(int)
    for i, _, _, s in rows:
        size[s] += tokens[i]
    want = op6_mixing.plan(dict(size))
    for block in (op6_mixing.BLOCK_TOKENS, 300):
        got = op6_mixing.mix(docs, block_tokens=block).collect()
        times = Counter((r.doc_id, r.source) for r in got)
        assert {d for d, _ in times} == {*tokens}
        assert all(r.n_tokens == tokens[r.doc_id] for r in got)
        for s, n in size.items():
            read = sum(r.n_tokens for r in got if r.source == s)
            biggest = max(tokens[i] for i, _, _, x in rows if x == s)
            assert n * want.repeats[s] - biggest - 1 <= read <= n * want.repeats[s] + 1
            assert max(c for (d, x), c in times.items() if x == s) <= math.ceil(op6_mixing.MAX_REPEAT)
        assert len({(r.doc_id, r.epoch) for r in got}) == len(got)


def test_mix_with_budget_odd_rows_and_nothing(odd, none, docs):
    total = sum(r.n_tokens for r in op6_mixing.mix(docs, budget=2000).collect())
    assert total <= 2000
    assert op6_mixing.mix(odd).count() >= odd.count()
    assert op6_mixing.mix(none).count() == 0
