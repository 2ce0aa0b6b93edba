import random

import pytest

SYL = "the of and er th on ing re ti ha en es".split()


def words(rnd, n):
    return ["".join(rnd.choice(SYL) for _ in range(rnd.randint(1, 4))) for _ in range(n)]


def corpus(seed=3):
    """(doc_id, text, lang, source): copies, near copies, shared passages, nulls, empty and very long texts."""
    rnd = random.Random(seed)
    passage = words(rnd, 70)
    texts = [None, "", "   \n\t", "!!! ??? ###", "One.", "One.", "é", "a" * 3000, "ab " * 900]
    base = words(rnd, 260)
    texts += [" ".join(base)] * 4
    for _ in range(4):
        near = list(base)
        for _ in range(10):
            near[rnd.randrange(len(near))] = "changed" + str(rnd.randrange(99))
        texts.append(" ".join(near))
    for _ in range(6):
        w = words(rnd, rnd.randint(5, 160))
        at = rnd.randrange(len(w))
        texts.append(" ".join(w[:at] + passage[: rnd.choice([49, 50, 51, 70])] + w[at:]) + "\nÜber çava")
    texts.append(" ".join(words(rnd, 20000)))
    texts += [" ".join(words(rnd, rnd.randint(1, 200))) for _ in range(20)]
    order = list(range(len(texts)))
    rnd.shuffle(order)
    langs = [None if i % 7 == 0 else "en" if i % 2 else "xx" for i in order]
    return [(i, texts[k], langs[i], None if i % 11 == 0 else "hot" if i % 3 else f"s{i % 4}") for i, k in enumerate(order)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def odd(spark, rows):
    """Repeated rows, repeated and null ids, clashing extra columns."""
    twice = rows + rows[:8] + [(None, rows[12][1], "en", "z"), (5, rows[13][1], None, None)]
    cols = "doc_id long, text string, lang string, source string, n_words long, mkey string, node string, score string, epoch string, kept string"
    return spark.createDataFrame([(*r, 7, "m", "n", "s", "e", "k") for r in twice], cols)
