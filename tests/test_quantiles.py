"""Exact quantiles of groups too large for one task, by selection, against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from simloom.operators import metrics, registry

SHARES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def values(kind, n, rng):
    of = {"even": lambda: rng.random(), "steep": lambda: 10.0 ** rng.uniform(-200, 200), "one": lambda: 5.0 if rng.random() < 0.7 else rng.gauss(5, 1), "same": lambda: 3.0, "whole": lambda: float(rng.randrange(7))}
    return [of[kind]() for _ in range(n)]


def test_selection_equals_numpy(spark, monkeypatch):
    monkeypatch.setattr(metrics, "HELD", 50)
    monkeypatch.setattr(metrics, "SORTED", 8)
    monkeypatch.setattr(metrics, "CUTS", 4)
    rng = random.Random(1)
    groups = {k: values(k, 1500, rng) for k in ("even", "steep", "one", "same", "whole")} | {"few": values("even", 9, rng), "single": [1.5], None: values("even", 300, rng)}
    rows = [(k, v) for k, vs in groups.items() for v in [*vs, None]]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "kind string, v double")
    got = {r.kind: list(r.q) for r in metrics.exact_quantiles(df, ["kind"], F.col("v"), SHARES).collect()}
    assert got.keys() == groups.keys()
    for k, vs in groups.items():
        assert got[k] == pytest.approx(np.quantile(vs, SHARES).tolist(), rel=1e-12), k


def test_summaries_by_both_ways(spark, monkeypatch):
    """Statistics, distances, rules and thresholds are the same by hash tables and by selection."""
    rng = random.Random(2)
    df = spark.createDataFrame([(k, rng.random(), float(k % 2), rng.choice("ab"), rng.randrange(9), rng.randrange(1, 5)) for k in range(800)], "id long, score double, label double, kind string, d int, l int")
    both = []
    for held in (10**6, 20):
        monkeypatch.setattr(metrics, "HELD", held)
        made = (metrics.stats_by(df, "score", "label"), metrics.distance_summary(df, "d", "l", ["kind"]), metrics.rule_quantiles(df, ["kind", "label"], "score", 100), registry.above_threshold(df, 0.1, 0.3)[0], metrics.rule_quantiles(df.limit(0), ["kind"], "score", 1))
        both.append([sorted([str([round(v, 9) if isinstance(v, float) else v for v in (r[c] for c in sorted(x.columns))]) for r in x.collect()]) for x in made])
    assert both[0] == both[1] and all(both[0][:4])
