"""op7 and op10 against brute force, in normal and in split buckets."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenant.llm import kernels as K
from provenant.llm import op7_suffix, op10_substring
from provenant.llm import windows as W
from provenant.llm.radix import equal_prefixes
from provenant.llm.windows import Spec, sort_windows


def covered(n, starts, length):
    d = np.zeros(n + 1, int)
    for s in starts:
        d[s] += 1
        d[s + length] -= 1
    return np.cumsum(d)[:n] > 0


def brute7(rows):
    length = op7_suffix.LENGTH
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(x[p : p + length] for _, x in texts for p in range(len(x) - length + 1))
    out = []
    for i, x in texts:
        gone = covered(len(x), [p for p in range(len(x) - length + 1) if seen[x[p : p + length]] > 1], length)
        left = np.frombuffer(x, np.uint8)[~gone].tobytes()
        out.append((i, len(x), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return out


def brute10(rows):
    length = op10_substring.LENGTH
    low = lambda i: float("-inf") if i is None else i
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in texts:
        for p in range(len(w) - length + 1):
            key = tuple(w[p : p + length])
            first[key] = min(first.get(key, float("inf")), low(i))
    out = []
    for i, w in texts:
        gone = covered(len(w), [p for p in range(len(w) - length + 1) if first[tuple(w[p : p + length])] < low(i)], length)
        left = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), int(gone.sum()), hashlib.sha256(left.encode()).hexdigest()))
    return out


def same(df, want):
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, df.collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("hot", [4096, 0])
def test_op7(docs, rows, hot):
    same(op7_suffix.digest(docs, hot), brute7([r[:2] for r in rows]))


@pytest.mark.parametrize("hot", [4096, 0])
def test_op10(docs, rows, hot):
    same(op10_substring.digest(docs, hot), brute10([r[:2] for r in rows]))


def test_repeated_and_null_ids(odd):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    same(op7_suffix.digest(odd), brute7(rows))
    same(op10_substring.digest(odd), brute10(rows))


def test_empty(none):
    assert op7_suffix.digest(none).count() == 0 and op10_substring.digest(none).count() == 0


def test_kept_texts(docs, rows):
    kept = {r.doc_id: r.kept for r in op7_suffix.remove_repeats(docs).collect()}
    want = {r[0]: r[4] for r in brute7([r[:2] for r in rows])}
    assert {i: hashlib.sha256(bytes(k)).hexdigest() for i, k in kept.items()} == want
    kept = {r.doc_id: r.kept for r in op10_substring.remove_repeats(docs).collect()}
    want = {r[0]: r[3] for r in brute10([r[:2] for r in rows])}
    assert {i: hashlib.sha256(k.encode()).hexdigest() for i, k in kept.items()} == want


def test_sorted_windows_are_classes():
    rng = np.random.default_rng(1)
    for tokens, length, kind in ((rng.integers(0, 2, 400).astype(np.uint8), 9, "bytes"), (rng.integers(0, 3, 300), 5, "words"), (rng.integers(0, 2, 90).astype(np.uint8), 3, "bytes")):
        start = np.arange(len(tokens) - length + 1)
        spec, bucket = Spec(length, 2, kind, False), np.zeros(len(start), np.int64)
        cls = sort_windows(spec, tokens, start, bucket)
        assert ((cls >= 0) == (sort_windows(spec, tokens, start, bucket, False) >= 0)).all()
        seen = Counter(tokens[s : s + length].tobytes() for s in start)
        for s in start:
            mine = tokens[s : s + length].tobytes()
            assert (cls[s] >= 0) == (seen[mine] > 1)
        groups = {}
        for s in start[cls >= 0]:
            assert groups.setdefault(cls[s], tokens[s : s + length].tobytes()) == tokens[s : s + length].tobytes()


def test_word_hashes_of_a_long_row_match_short_ones(monkeypatch):
    text = ("word Wörter 12 x" * 500 + " end ").encode()
    buf, at = np.frombuffer(text, np.uint8), np.zeros(1, np.int64)
    whole = K.words(buf, at, K.ALNUM, lower=True)
    monkeypatch.setattr(K, "SLICE_BYTES", 100)
    parts = K.words(buf, at, K.ALNUM, lower=True)
    for a, b in zip(whole, parts):
        assert (a == b).all()


def test_colliding_hashes_fall_back_to_tokens(monkeypatch):
    monkeypatch.setattr(K, "window_hash", lambda pre, k, which: np.zeros(len(pre) - k, np.uint64))
    tokens = np.frombuffer(b"abcdefghij" * 2 + b"klmnopqrst", np.uint8)
    start = np.array([0, 10, 20, 1])
    assert (sort_windows(Spec(9, 2, "bytes", False), tokens, start, np.zeros(4, np.int64)) >= 0).tolist() == [True, True, False, False]


def test_more_rows_of_a_doc_id_than_twenty_bits_hold(spark):
    n = (1 << 20) + 5
    docs = spark.range(n, numPartitions=4).selectExpr("CAST(NULL AS long) AS doc_id", "'' AS text").unionByName(spark.createDataFrame([(0, ""), (0, "a"), (1, "")], "doc_id long, text string"))
    rows, odd = W.numbered(docs)
    assert odd and rows.select("doc").distinct().count() == rows.count() == n + 3
    places = {r.doc_id: (r.a, r.b) for r in rows.groupBy("doc_id").agg(F.min("place").alias("a"), F.max("place").alias("b")).collect()}
    assert all(a == b for a, b in places.values()) and places[None] < places[0] < places[1]


def test_the_least_doc_id_there_is_comes_after_null(spark):
    docs = spark.createDataFrame([(-(1 << 63), "a"), (None, "b"), (5, "c"), (5, "d")], "doc_id long, text string")
    places = {r.text: r.place for r in W.numbered(docs)[0].collect()}
    assert places["b"] < places["a"] < places["c"] == places["d"]


def test_words_made_to_collide_stay_different(spark):
    a, b = ("".join(x if bin(i).count("1") % 2 == 0 else y for i in range(1024)) for x, y in ("ab", "ba"))
    rest = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join([*rest[:30], a, *rest[30:]])), (2, " ".join([*rest[:30], b, *rest[30:]])), (3, " ".join([*rest[:30], b, *rest[30:]])), (4, " ".join(a)), (5, " ".join(b))]
    same(op10_substring.digest(spark.createDataFrame(rows, "doc_id long, text string")), brute10(rows))


def test_radix_groups_are_strings_in_order():
    rng = np.random.default_rng(0)
    for length in (8, 9, 16, 20, 200):
        text = rng.integers(0, 2, 3000).astype(np.uint8)
        text[1000:1500] = text[:500]
        start = np.arange(len(text) - length + 1)
        part = rng.integers(0, 3, len(start))
        got = equal_prefixes(text, start, part, length)
        key = [(p, text[s : s + length].tobytes()) for s, p in zip(start, part)]
        seen = Counter(key)
        assert [g >= 0 for g in got] == [seen[k] > 1 for k in key]
        names = {}
        for k, g in zip(key, got):
            assert g < 0 or names.setdefault(g, k) == k
        assert [names[g] for g in sorted(names)] == sorted(names.values())
