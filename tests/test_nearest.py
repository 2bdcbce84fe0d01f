"""Search by partition of space against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from simloom.functions import batch_edit
from simloom.operators import nearest, similarity_join
from simloom.plans.inputs import tokens


def brute(targets, names, k, cutoff, window=None):
    out = set()
    for t in targets:
        d = batch_edit.levenshtein([(t, n) for n in names]).tolist()
        near = sorted((x, n) for x, n in zip(d, names, strict=True) if x <= cutoff and (window is None or abs(len(n) - len(t)) <= window))
        most = near[min(k, len(near)) - 1][0] if k and near else cutoff
        out |= {(t, n, x) for x, n in near if x <= most}
    return out


def test_nearest_tokens_against_brute_force(spark, sf, monkeypatch):
    """5,000 document tokens: all of the nearest are found, and under a tenth of all pairs are compared."""
    names = [r.name for r in tokens(spark, sf).orderBy(F.xxhash64("name")).limit(5000).collect()]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    told = []
    got = nearest.nearest_texts(df, df, 4, 64, told=told).collect()
    assert told[0] < len(names) ** 2 / 10
    some = set(names[:400])
    assert {tuple(r) for r in got if r.left_name in some} == brute(sorted(some), names, 4, 64)
    assert {r.left_name for r in got} == set(names)


@pytest.mark.parametrize("k,cutoff,window", [(3, 64, None), (2, 3, 1), (None, 2, None), (1, 1, 0)])
def test_windows_cutoffs_and_small_leaves(spark, monkeypatch, k, cutoff, window):
    monkeypatch.setattr(nearest, "LEAF_ROWS", 8)
    monkeypatch.setattr(nearest, "POINTS", 5)
    monkeypatch.setattr(nearest, "QUERIES", 3)
    rng = random.Random(2)
    names = sorted({"".join(rng.choice("abcé漢") for _ in range(rng.randrange(0, 9))) for _ in range(150)} | {"x" * 100})
    asked = names[::3] + ["not there", "x" * 99 + "y"]
    frame = lambda v: spark.createDataFrame([(n,) for n in v], "name string")
    got = nearest.nearest_texts(frame(asked), frame(names), k, cutoff, window)
    assert {tuple(r) for r in got.collect()} == brute(asked, names, k, cutoff, window)
    assert nearest.nearest_texts(frame(asked), frame([]), k, cutoff, window).count() == 0


def test_nearest_by_features_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nearest, "LEAF_ROWS", 16)
    rng = random.Random(3)
    schema = "id long, block long, distance double, f double, g double"
    rows = [(k, rng.choice([1, 2, None]), rng.random() * 9, rng.random(), float(rng.randrange(3))) for k in range(60)]
    points = [(k, rng.choice([1, 1, 2, 3, None]), rng.random() * 9, rng.random(), float(rng.randrange(3))) for k in range(400)] + [(1000 + k, 2, 1.0, 0.5, 1.0) for k in range(50)]
    told = []
    got = {r.id: (r.candidate, r.objective) for r in similarity_join.nearest_by_features(spark.createDataFrame(rows, schema), spark.createDataFrame(points, schema), ["f", "g"], best=1, told=told).collect()}
    want = {}
    for i, b, d, f, g in rows:
        near = sorted((round(((f - y) ** 2 + (g - z) ** 2) ** 0.5 + 0.15 * abs(d - x), 9), j) for j, c, x, y, z in points if c == b and b is not None)
        if near:
            want[i] = (near[0][1], near[0][0])
    assert got == {i: (c, pytest.approx(o)) for i, (c, o) in want.items()}
    assert told[0] < sum(b == c for _, b, *_ in rows for _, c, *_ in points) / 2


@pytest.mark.parametrize("many", [0, 600])
def test_nearest_by_features_ties_once_rounded(spark, monkeypatch, many):
    """0.15 * (0.3 - 0.1) and 0.15 * (0.5 - 0.3) differ in their last bits only: a tie that the smaller id wins, in another leaf too."""
    monkeypatch.setattr(nearest, "LEAF_ROWS", 16)
    assert 0.15 * abs(0.3 - 0.1) < 0.15 * abs(0.3 - 0.5) and round(0.15 * abs(0.3 - 0.1), 9) == round(0.15 * abs(0.3 - 0.5), 9)
    schema = "id long, block long, distance double, f double"
    points = [(1, 1, 0.5, 0.0), (2, 1, 0.1, 0.0)] + [(10 + k, 1, 0.6 + k, 0.0) for k in range(many // 2)] + [(1000 + k, 1, -0.6 - k, 0.0) for k in range(many // 2)]
    got = similarity_join.nearest_by_features(spark.createDataFrame([(7, 1, 0.3, 0.0)], schema), spark.createDataFrame(points, schema), ["f"], best=1).collect()
    assert [(r.id, r.candidate, round(r.objective, 9)) for r in got] == [(7, 1, 0.03)]
