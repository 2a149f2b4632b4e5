"""Counting similar documents against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kbspark.operators import importance as imp, similar


def texts():
    rnd = random.Random(11)
    word = lambda: f"w{rnd.randrange(10**6)}"
    out = []
    for size in (240, 60, 30):       # families of drifting texts, some just over, some just under 0.8
        line = [word() for _ in range(size)]
        for i in range(30):
            out.append(" ".join(line))
            line = list(line)
            for _ in range(1 + i % 4):
                line[rnd.randrange(size)] = word()
    out += [out[0]] * 40             # a third are one text
    out += [out[0].upper() + "  ", "one two", "One  two", "three", "", None, " \n ", "la " * 200, "la " * 300, "x" * 3000]
    return out


def brute(texts):
    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [grams(t) for t in texts]
    return [sum(i != j and a and len(a & b) / len(a | b) >= 0.8 for j, b in enumerate(sets)) if a else 0 for i, a in enumerate(sets)]


@pytest.mark.parametrize("part", [250, 7])
def test_counts_equal_those_of_all_pairs(spark, part):
    rows = [(i, t, "n", 1) for i, t in enumerate(texts())]
    want = brute([t for _, t, *_ in rows])
    df = spark.createDataFrame(rows, "document_id long, text string, rep string, weight int").repartition(4)
    got = {r.document_id: r.importance for r in imp.similar_importance(df, part=part).collect()}
    assert got == dict(enumerate(want)) and max(want) >= 41 and len(got) == len(rows)


def test_odd_rows(spark):
    none = spark.createDataFrame([], "document_id long, text string")
    assert imp.similar_importance(none).count() == 0
    text = "a b c d e f g"
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (None, text), (2, None), (3, "other words here")], "document_id long, text string")
    got = sorted((r.document_id is None, r.document_id or 0, r.importance) for r in imp.similar_importance(df).collect())
    assert got == [(False, 1, 3), (False, 1, 3), (False, 2, 0), (False, 3, 0), (True, 0, 0), (True, 0, 0)]


def test_no_row_per_pair(spark):
    """A family of near copies: what the last step returns is one number per member and block."""
    base = [f"w{i}" for i in range(150)]
    df = spark.createDataFrame([(i, " ".join(base[:i % 140] + [f"own{i}"] + base[i % 140 + 1:])) for i in range(300)], "document_id long, text string")
    seen = []
    counts = similar._counts
    similar._counts = lambda rows, s: seen.append(out := counts(rows, s)) or out
    try:
        got = imp.similar_importance(df, part=100).agg(F.min("importance"), F.max("importance")).first()
    finally:
        similar._counts = counts
    assert tuple(got) == (299, 299) and seen[0].count() <= 300 * 3 * similar.BANDS < 300 * 299


def test_missed_links_at_the_threshold():
    """Sets of similarity 0.8: the share that no band holds, and the sketch test, on 20,000 pairs."""
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(20_000):
        pool = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
        sets += [np.unique(pool[:54]), np.unique(pool[6:])]     # 48 of 60
    sig = similar.sketches(sets, similar.BANDS * similar.ROWS)
    a, b = sig[0::2], sig[1::2]
    agree = a == b
    lost = ~agree.reshape(-1, similar.BANDS, similar.ROWS).all(axis=2).any(axis=1)
    assert abs(agree.mean() - 0.8) < 0.003 and lost.mean() < 0.0006
