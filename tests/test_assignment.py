"""Assignment by lists against the sequential rule, with hot lists, first keys and lists that grow."""

import random

import pytest
from pyspark.sql import functions as F

from simloom.operators import assignment

@pytest.fixture(autouse=True, params=[0, 2_000_000], ids=["rounds", "turns"])
def turns(request, monkeypatch):
    monkeypatch.setattr(assignment, "TURNS", request.param)
    return request.param


LISTS, ROWS = "list string, pref int, key string", "row_idx long, list string"


def sequential(rows, lists, taken=()):
    used, out = set(taken), {}
    for row, name, *first in sorted(rows):
        for pref, key in [(0, f) for f in first if f is not None] + sorted(lists.get(name, [])):
            if key not in used:
                used.add(key)
                out[row] = (key, pref)
                break
    return out


def frames(spark, rows, lists):
    flat = [(name, p, k) for name, ks in lists.items() for p, k in ks]
    return spark.createDataFrame(rows, ROWS + (", first string" if len(rows[0]) > 2 else "")), spark.createDataFrame(flat, LISTS)


def got(df):
    return {r.row_idx: (r.key, r.pref) for r in df.collect()}


@pytest.mark.parametrize("n", [10, 1000])
def test_one_list_for_all_takes_few_rounds(spark, n):
    rows, lists = [(k, "a") for k in range(n)], {"a": [(p, f"k{p * 7919 % n}") for p in range(n)]}
    told = []
    assert got(assignment.assign_lists(*frames(spark, rows, lists), told=told)) == sequential(rows, lists)
    assert told[0] <= 2
    same = spark.createDataFrame([(r, p, f"k{p}") for r in range(40) for p in range(40)], "row_idx long, pref int, key string")
    assert {r.row_idx: r.key for r in assignment.assign_unique(same).collect()} == {r: f"k{r}" for r in range(40)}


def test_one_hot_list_among_others(spark, monkeypatch):
    """Rows of one list stand in several blocks, and others have taken from its middle."""
    monkeypatch.setattr(assignment, "BLOCK", 16)
    rng = random.Random(1)
    rows = [(k, "hot" if k % 3 else f"l{k % 20}") for k in range(300)]
    lists = {"hot": [(p, f"k{p}") for p in range(230)]} | {f"l{m}": [(p, f"k{j}") for p, j in enumerate(rng.sample(range(260), 12))] for m in range(20)}
    told = []
    assert got(assignment.assign_lists(*frames(spark, rows, lists), told=told)) == sequential(rows, lists)
    assert told[0] < 40


@pytest.mark.parametrize("seed", range(3))
def test_random_lists_first_keys_and_taken(spark, monkeypatch, seed):
    monkeypatch.setattr(assignment, "LOOK", 2)
    monkeypatch.setattr(assignment, "BLOCK", 3)
    rng = random.Random(seed)
    lists = {f"l{m}": [(rng.randrange(9), f"k{j}") for j in rng.sample(range(30), rng.randrange(1, 14))] for m in range(6)}
    rows = [(k, f"l{rng.randrange(7)}", rng.choice([None, f"k{rng.randrange(30)}", f"f{k}"])) for k in range(40)]
    taken = ["k3", "k4", "f7"]
    a, b = frames(spark, rows, lists)
    assert got(assignment.assign_lists(a, b, spark.createDataFrame([(t,) for t in taken], "key string"))) == sequential(rows, lists, taken)


def test_lists_that_grow_when_they_are_asked(spark):
    rng = random.Random(5)
    whole = {f"l{m}": [(p, f"k{j}") for p, j in enumerate(rng.sample(range(40), 20))] for m in range(5)}
    rows = [(k, f"l{rng.randrange(5)}") for k in range(45)]
    a, _ = frames(spark, rows, whole)
    part = lambda low, high: spark.createDataFrame([(m, p, k) for m, ks in whole.items() for p, k in ks if low <= p < high], LISTS)
    asked = []

    def more(ended):
        asked.append(ended.count())
        n = len(asked)
        return part(5 * n, 5 * n + 5).join(ended, "list") if n < 4 else None

    assert got(assignment.assign_lists(a, part(0, 5), more=more)) == sequential(rows, whole)
    assert asked and asked[-1] <= 5


def test_nothing_to_give(spark):
    a, b = frames(spark, [(1, "x"), (2, None)], {"y": [(1, "k")]})
    assert got(assignment.assign_lists(a, b)) == {} and got(assignment.assign_lists(a.limit(0), b)) == {}
    assert got(assignment.assign_lists(a, b.withColumn("list", F.lit("x")))) == {1: ("k", 1)}
