"""Hard negatives against all pairs in plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lading.llm import hard_negatives as m

SCHEMA = "vec_id long, embedding array<double>, label int"
NAMES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute(rows, n_positives=5, n_negatives=10):
    kept = {}
    for i, v, label in rows:
        if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v):
            key = (label, [math.floor(256 * x) for x in v])
            kept[i] = min(kept.get(i, key), key)
    clip = lambda s: max(-m.MOST_SCORE, min(m.MOST_SCORE, s))
    out = set()
    for a, (label, v) in kept.items():
        if a % 100:
            continue
        scores = [(-clip(sum(x * y for x, y in zip(v, w))), i, other == label) for i, (other, w) in kept.items() if i != a and len(w) == len(v)]
        scores.sort()
        for p, i, _ in [s for s in scores if s[2]][:n_positives]:
            fit = [(n, j) for n, j, same in scores if not same and 30 * -p <= 100 * -n <= 90 * -p][:n_negatives]
            out |= {(a, i, rank, j, -p, -n) for rank, (n, j) in enumerate(fit, 1)}
    return out


def mined(spark, rows, schema=SCHEMA, **kw):
    df = spark.createDataFrame(rows, schema).repartition(3)
    return {tuple(r[n] for n in NAMES) for r in m.hard_negatives(df, F.col("vec_id") % 100 == 0, **kw).collect()}


def vectors(n, dim, seed, labels=4):
    r = random.Random(seed)
    centre = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(labels)]
    return [(i, [0.6 * c + r.gauss(0, 0.5) for c in centre[i % labels]], r.randrange(labels)) for i in range(n)]


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(m, "BLOCK_ROWS", 64)
    monkeypatch.setattr(m, "BLOCK_ANCHORS", 2)
    monkeypatch.setattr(m, "BINS", 16)


def test_all_pairs_over_many_blocks(spark, small_blocks):
    rows = vectors(900, 6, 1)
    want = brute(rows)
    assert len(want) > 200 and mined(spark, rows) == want


def test_copies_fill_the_last_place(spark, small_blocks):
    rows = vectors(600, 4, 2)
    one = [0.5, 0.25, -0.5, 0.75]
    rows += [(1000 + i, one, i % 3) for i in range(300)]  # a third of all rows are one vector: scores tie over blocks
    want = brute(rows)
    assert mined(spark, rows) == want and {r[3] for r in want} & set(range(1000, 1300))


def test_awkward_rows(spark):
    rows = vectors(250, 3, 3)
    rows += [(None, [1.0, 1.0, 1.0], 1), (500, None, 1), (501, [1.0, None, 1.0], 1), (502, [float("nan"), 1.0, 1.0], 1), (503, [float("inf"), 1.0, 1.0], 0), (504, [1.0, 1.0, 1.0], None)]
    rows += [(600, [1.0], 0), (601, [2.0], 0), (602, [1.0], 1), (700, [], 0), (701, [], 0), (702, [], 1)]  # other lengths meet their own
    rows += [(-100, [0.5, 0.5, 0.5], 1), rows[0], rows[7], (7, [0.0, 0.0, 0.0], 0)]  # repeated rows, one id with two vectors
    assert mined(spark, rows) == brute(rows)


def test_scores_beyond_doubles(spark):
    r = random.Random(5)
    rows = [(i, [r.choice([1e6, 1.0]) * r.random() * 3e4 for _ in range(4)], i % 2) for i in range(0, 300, 10)]
    assert mined(spark, rows) == brute(rows)
    huge = [(i, [r.random() * 1e14, 1e200], i % 2) for i in range(0, 300, 50)]
    got = mined(spark, huge)
    assert all(abs(x) <= m.MOST_SCORE for row in got for x in row[4:])


def test_no_rows_and_clashing_names(spark):
    assert mined(spark, []) == set()
    assert mined(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == set()  # no anchors
    rows = vectors(220, 3, 4)
    extra = ("id", "q", "dim", "row", "x", "block", "part", "anchor", "w", "lo", "hi", "step", "n")
    schema = SCHEMA + "".join(f", {c} string" for c in extra)
    assert mined(spark, [(*row, *["?"] * len(extra)) for row in rows], schema) == brute(rows)


def test_other_sizes(spark):
    rows = vectors(260, 3, 6)
    assert mined(spark, rows, n_positives=2, n_negatives=3) == brute(rows, 2, 3)
