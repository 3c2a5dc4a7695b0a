"""Hard negatives against a score of every anchor with every row."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from copperline.llm import hard_negatives as hard

SCHEMA = "vec_id long, embedding array<double>, label int, `a.b` int, score int"


def by_all_pairs(rows, every, positives=5, negatives=5):
    used = [(i, lab, [math.floor(256 * x) for x in v]) for i, v, lab, *_ in rows
            if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a in {(i, lab, tuple(v)) for i, lab, v in used if i % every == 0}:
        scored = [(-sum(map(lambda x, y: x * y, a[2], v)), i, lab) for i, lab, v in used if i != a[0] and len(v) == len(a[2])]
        scored.sort()
        for neg_p, p, _ in [s for s in scored if s[2] == a[1]][:positives]:
            fits = [s for s in scored if s[2] != a[1] and 80 * -neg_p <= 100 * -s[0] <= 100 * -neg_p][:negatives]
            out += [(a[0], p, rank, n, -neg_p, -s) for rank, (s, n, _) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, every=10, **kwargs):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in hard.mine(df, F.col("id") % every == 0, **kwargs).collect())


def vectors(rng, n, dim=6):
    """Clustered vectors, so that bounds do cut; with ties, repeats, zeros and long ones."""
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        v = [round(x + rng.gauss(0, 0.2), 2) for x in c] if rng.random() < 0.9 else [0.0] * dim
        rows.append((i, v if rng.random() < 0.9 else [x * 40 for x in v], rng.randrange(3), 1, 2))
    return rows


def test_equal_to_all_pairs(spark):
    rng = random.Random(8)
    rows = vectors(rng, 400)
    rows += [rows[3], rows[10], rows[10], (20, rows[7][1], 1, 1, 2)]
    rows += [(None, [1.0] * 6, 1, 1, 2), (1000, None, 1, 1, 2), (1010, [1.0] * 6, None, 1, 2), (1020, [1.0, None] * 3, 1, 1, 2),
             (1030, [float("nan")] * 6, 1, 1, 2), (1040, [float("inf")] * 6, 1, 1, 2), (1050, [1.0] * 3, 1, 1, 2), (1051, [2.0] * 3, 1, 1, 2),
             (1052, [1.5] * 3, 2, 1, 2), (1060, [], 1, 1, 2), (1061, [], 1, 1, 2), (1062, [], 0, 1, 2)]
    expected = by_all_pairs(rows, 10)
    assert len(expected) > 300
    assert mined(spark, rows) == expected
    # neither the size of a group nor that of a window changes anything
    assert mined(spark, rows, group_rows=37) == expected


def test_few_positives_and_empty_tables(spark):
    rows = [(0, [1.0, 0.0], 0, 1, 2), (1, [0.9, 0.1], 0, 1, 2), (2, [0.8, 0.2], 1, 1, 2), (3, [-1.0, 0.0], 1, 1, 2)]
    assert mined(spark, rows) == by_all_pairs(rows, 10) != []
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 0, 1, 2)]) == []


def test_huge_components_are_exact(spark):
    rng = random.Random(9)
    rows = [(i, [float(rng.randrange(-2 ** 22, 2 ** 22)) + 0.5 for _ in range(4)], i % 2, 1, 2) for i in range(40)]
    assert mined(spark, rows) == by_all_pairs(rows, 10)


def test_bounds_hold_and_cut():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(4, 8)) * 100
    matrix = np.floor(np.concatenate([c + rng.normal(size=(300, 8)) * 8 for c in centres]))
    refs = hard._unit(centres)
    angles = hard._angles(matrix, refs)
    group = hard.Group(np.arange(1200), np.repeat(np.arange(4), 300), matrix, angles)
    low, high = group.bounds(hard._norms(matrix[::100]), angles[::100])
    for w in range(len(group.windows)):
        scores = group.scores(matrix[::100], w)
        assert (scores <= high[:, w, None]).all() and (scores >= low[:, w, None]).all()
    # most windows of other clusters cannot reach what the own cluster scores
    own = (matrix[::100] ** 2).sum(axis=1)
    assert (high < 0.8 * own[:, None]).mean() > 0.3
