"""op1 against all pairs."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from provenant.llm import op1_simhash as S


def brute(rows):
    """(doc_id, class_id, n_links, n_copies) of rows doc_id, text."""
    prints = S.fingerprints(pa.array([t for _, t in rows]))
    some = [k for k, (_, t) in enumerate(rows) if t is not None]
    distinct, at = np.unique(prints[some], axis=0, return_inverse=True)
    at = at.ravel()
    far = np.bitwise_count(distinct[:, None] ^ distinct[None]).sum(axis=2)
    close = (far <= S.MAX_DISTANCE) & ~np.eye(len(distinct), dtype=bool)
    root = np.arange(len(distinct))
    while True:
        new = np.array([min([root[i], *root[close[i]]]) for i in range(len(root))])
        if (new == root).all():
            break
        root = new
    least = defaultdict(lambda: 1 << 62)
    for k, f in zip(some, at):
        least[root[f]] = min(least[root[f]], rows[k][0])
    out = [(rows[k][0], least[root[f]], int(close[f].sum()), int((at == f).sum())) for k, f in zip(some, at)]
    return sorted(out + [(i, i, 0, 1) for i, t in rows if t is None])


@pytest.mark.parametrize("block,sent,sample", [(S.BLOCK, S.SENT, S.SAMPLE), (2, S.SENT, 1), (S.BLOCK, 20.0, 1)])
def test_all_links(docs, rows, block, sent, sample):
    got = sorted(map(tuple, S.near_duplicates(docs, block=block, sent=sent, sample=sample).collect()))
    assert got == brute([r[:2] for r in rows])
    assert sum(n > 1 for n in [x[3] for x in got]) >= 4 and sum(x[2] > 0 for x in got) >= 8


@pytest.mark.parametrize("p", [S.Plan(16, 3, 512, 2, 28), S.Plan(16, 3, 256, 3, 40)])
def test_deeper_levels_find_the_classes(docs, rows, p):
    want = brute([r[:2] for r in rows])
    linked = [i for i, _, n, _ in want if n]
    got = {tuple(r) for r in S.near_duplicates(docs.where(docs.doc_id.isin(linked)), sent=200.0, parameters=p).collect()}
    assert got <= {x for x in want} and len(got) == len(linked)


def at_distance(n, distance, seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 1 << 63, size=(n, 4), dtype=np.uint64)
    bits = np.zeros((n, 256), np.uint8)
    for row in bits:
        row[rng.permutation(256)[:distance]] = 1
    return x, x ^ np.packbits(bits, axis=1).view(np.uint64)


@pytest.mark.parametrize("n,levels", [(1_000, 1), (250_000, 1), (10_000_000, 1), (1_000_000_000, 2), (10_000_000_000, 2), (0, 3)])
def test_planned_repetitions_reach_the_recall(n, levels):
    """What a repetition finds, measured on pairs at the largest distance, gives the recall of as many as are planned."""
    p = S.plan(n) if n else S.Plan(16, 3, 512, 3, S.repetitions(S.found_once(S.MAX_DISTANCE, 16, 3, 512, 3)))
    assert p.levels == levels and n * p.stay**p.levels <= S.BLOCK and p.sent * p.reps < 15_000
    some = S.Filters(S.Plan(p.strip, p.radius, p.centres, p.levels, min(p.reps, 30)))
    x, y = (np.unpackbits(z.view(np.uint8), axis=1) for z in at_distance(3000, S.MAX_DISTANCE, 11))
    met = np.ones((some.plan.reps, len(x)), bool)
    for r in range(some.plan.reps):
        for t in range(p.levels):
            met[r] &= (some.near(x, r, t) & some.near(y, r, t)).any(axis=1)
    found = met.mean()
    exact = S.found_once(S.MAX_DISTANCE, p.strip, p.radius, p.centres, p.levels)
    assert abs(found - exact) < 5 * (exact / met.size) ** 0.5 + 0.03 * exact
    assert 1 - (1 - exact) ** p.reps >= S.RECALL - 1e-9 and 1 - (1 - found) ** p.reps >= S.RECALL - 0.004


def test_roots_of_a_list_with_a_dense_cluster():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, size=(3, 4), dtype=np.uint64)
    flip = lambda n, most: np.packbits((rng.random((n, 256)) < most / 256), axis=1).view(np.uint64)
    fp = np.concatenate((base[0] ^ flip(1500, 12), base[1] ^ flip(40, 12), rng.integers(0, 1 << 63, size=(700, 4), dtype=np.uint64), base[2] ^ flip(600, 45)))
    fp = fp[rng.permutation(len(fp))]
    close = np.bitwise_count(fp[:, None] ^ fp[None]).sum(axis=2) <= S.MAX_DISTANCE
    want = np.arange(len(fp))
    while True:
        new = np.array([want[c].min() for c in close])
        if (new == want).all():
            break
        want = new
    assert (S._roots(fp) == want).all()
    side = rng.integers(0, 2, len(fp))
    x, y = np.nonzero(close & (side[:, None] != side[None]))
    got = S._roots(fp, side)
    assert (got[x] == got[y]).all() and (want[got] == want).all()


def test_odd_rows(odd):
    given = [(r.doc_id, r.text) for r in odd.where("doc_id IS NOT NULL").select("doc_id", "text").collect()]
    assert sorted(map(tuple, S.near_duplicates(odd.where("doc_id IS NOT NULL")).collect())) == brute(given)
    kept = S.deduplicate(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids))


def test_deduplicate_keeps_one_of_each_class(docs, rows):
    want = sorted({c for _, c, _, _ in brute([r[:2] for r in rows])})
    assert sorted(r.doc_id for r in S.deduplicate(docs).collect()) == want


def test_deduplicate_judges_rows_not_doc_ids(spark):
    rnd = random.Random(2)
    a, b, c, d = (" ".join("".join(rnd.choices("abcdefghij", k=6)) for _ in range(80)) for _ in range(4))
    rows = [(1, a), (2, a), (2, b), (3, c), (3, d), (4, d), (None, a), (None, c), (None, "alone here"), (None, "alone here"), (None, None), (None, None), (7, None)]
    got = [tuple(r) for r in S.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    want = [(1, a), (2, b), (3, c), (4, d), (None, "alone here"), (None, None), (None, None), (7, None)]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_empty(none):
    assert S.near_duplicates(none).count() == 0 and S.deduplicate(none).columns == none.columns


def test_short_texts_that_differ_stay_apart(spark):
    rows = [(i, t) for i, t in enumerate(["On.", "The of.", "And er th.", "Ing re.", "on", "The of,"])]
    got = {r.doc_id: r.class_id for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0, 5: 1}
