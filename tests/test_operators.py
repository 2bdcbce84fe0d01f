import itertools
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from simloom.functions.distance import full_damerau
from simloom.operators import assignment, checks, forest, generators, metrics, ranking, registry, sampling
from simloom.operators import similarity_join as J


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def names_df(spark, words):
    return spark.createDataFrame([(w,) for w in words], "name string")


@pytest.mark.parametrize("radius", [1, 2, 3, 5])
def test_range_join_equals_brute_force(spark, radius):
    rng = random.Random(radius)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(0, 9))) for _ in range(90)} | {"x" * 23 + t for t in ("", "a", "ab", "abc", "b", "abcd")})
    got = {(r.left_name, r.right_name, r.distance) for r in J.range_join(names_df(spark, words), names_df(spark, words), radius).collect()}
    assert got == {(a, b, lev(a, b)) for a, b in itertools.product(words, words) if lev(a, b) <= radius}


@pytest.mark.parametrize("radius", [2, 4])
def test_range_join_collects_no_side(spark, tmp_path, radius):
    """A stored table of names is small, what its names are looked up by is not: no side may be broadcast."""
    names_df(spark, ["abcd", "abce", "x" * 30]).write.parquet(str(tmp_path / "names"))
    names = spark.read.parquet(str(tmp_path / "names"))
    joined = J.range_join(names, names, radius)
    assert joined.count() == 5
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_range_join_of_numbered_names(spark, tmp_path, monkeypatch, radius):
    """Names that are alike but for some places meet once, at their distance: nothing is verified or made distinct. Also with other lengths, and on two sides."""
    numbers = [f"Customer#{k:09d}" for k in range(0, 3000, 41)] + ["Customer#000001212", "Customer#000002121", "Customer#000012002", "Customer#000020012", "Customer#000012345", "Customer#000023451"]
    names_df(spark, sorted(set(numbers))).write.parquet(str(tmp_path / "names"))
    names = spark.read.parquet(str(tmp_path / "names"))
    pairs = lambda rows: sorted((r.left_name, r.right_name, r.distance) for r in rows)
    near = lambda one, two: sorted((a, b, lev(a, b)) for a, b in itertools.product(one, two) if lev(a, b) <= radius)
    joined = J.range_join(names, names, radius)
    assert pairs(joined.collect()) == near(set(numbers), set(numbers))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert radius == 0 or "Aggregate" not in plan and "levenshtein" not in plan
    rng = random.Random(radius)
    mixed = sorted({"né-00" + "".join(rng.choice("01\U0001F600") for _ in range(5)) + end for end in ("", "0", "1z") for _ in range(15)} | {"x" * 25 + t for t in ("", "a", "ab", "abc", "b")} | {""})
    other = sorted({"né-00" + "".join(rng.choice("01é") for _ in range(5)) + end for end in ("", "0", "1z") for _ in range(15)} | {"x" * 24 + t for t in ("", "a", "ab", "abc")})
    assert pairs(J.range_join(names_df(spark, mixed), names_df(spark, other), radius).collect()) == near(mixed, other)
    monkeypatch.setattr(J, "FEWER", 0)  # every length
    words = ["".join(t) for t in itertools.product("ab", repeat=5)] + ["", "a", "b", "abc", "aabbaa"]
    assert pairs(J.range_join(names_df(spark, words), names_df(spark, words), radius).collect()) == near(words, words)


def test_range_join_d2_counts_copies(spark, tmp_path):
    """SQL gives a pair for each copy of both names."""
    import duckdb

    from simloom.plans import catalog

    names = ["Customer#001"] * 3 + ["Customer#012"] * 2 + ["Customer#900", "Customer#10", None, None, ""]
    names_df(spark, names).withColumnRenamed("name", "c_name").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    got = catalog.queries()["range_join_d2"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(db.execute(catalog.oracle_sql()["range_join_d2"]).fetchall())
    assert len(got) > 6


def test_knn_cosine_by_tiles(spark, monkeypatch):
    """Tiles, blocks of queries, copies, vectors of odd lengths and without norm: the same as pair by pair, in fewer rows than pairs."""
    monkeypatch.setattr(J, "TILE", 32)
    monkeypatch.setattr(J, "BLOCK_ROWS", 20)
    rng = random.Random(5)
    base = [[rng.choice([-1.0, 0.5, 2.0]) for _ in range(6)] for _ in range(40)]
    rows = [(k, base[rng.randrange(40)]) for k in range(300)] + [(300, [0.0] * 6), (301, [1.0, 2.0]), (302, None), (303, [float("nan")] * 6), (304, [1.0, None, 0.0, 0.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "id long, vector array<float>")
    q = v.filter("id % 10 = 0 OR id >= 300").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    got = J.knn_cosine(q, v, 5)
    pairs = q.join(v, F.col("id") != F.col("query_id")).withColumn("similarity", F.round(J.cosine(F.col("query"), F.col("vector")), 9))
    want = pairs.withColumn("rank", F.row_number().over(J.Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))).filter("rank <= 5")
    told = lambda df: sorted(repr(tuple(r)) for r in df.select("query_id", "rank", "id", "similarity").collect())
    assert told(got) == told(want)
    assert "NestedLoop" not in J.knn_cosine(q.filter("query_id < 300"), v.filter("id < 300"), 5)._jdf.queryExecution().executedPlan().toString()


def test_nearest_names_and_picks(spark):
    words = ["google", "gogle", "goggle", "giggle", "amazon", "amazn", "zzzzzzzzzzzzzzzzzzzz"]
    df = names_df(spark, words).withColumn("key", F.lower("name"))
    near = [(r.neighbor, r.distance) for r in J.nearest_names(names_df(spark, ["google"]), df, k=3).orderBy("rank").collect()]
    assert near == [("goggle", 1), ("gogle", 1), ("giggle", 2)]
    picks = {r.target: r for r in J.pick_at_distance(df, df, goal=2, reach=3).collect()}
    assert picks["google"].neighbor == "giggle" and picks["google"]["mode"] == "exact_target"
    assert picks["amazon"].distance == 1 and picks["zzzzzzzzzzzzzzzzzzzz"]["mode"] == "global_length_fallback"


def test_length_ring_falls_back_to_all_names(spark):
    names = names_df(spark, ["abc", "abcd", "abcdefghij"])
    got = J.length_ring(names_df(spark, ["x" * 30, "xyz", "abcdefghij"]), names, 1).collect()
    assert sorted(map(tuple, got)) == [("x" * 30, "abc", 27), ("x" * 30, "abcd", 26), ("x" * 30, "abcdefghij", 20), ("xyz", "abc", 0)]


def test_contains_join(spark):
    names = spark.createDataFrame([("mmm", 0), ("amen", 1), ("th", 2)], "name string, row_idx int")
    rules = spark.createDataFrame([("mm",), ("m",), ("th",)], "source string")
    got = {(r.source, r.name, r.start) for r in J.contains_join(rules, names).collect()}
    assert got == {("mm", "mmm", 0), ("mm", "mmm", 1), ("m", "mmm", 0), ("m", "mmm", 1), ("m", "mmm", 2), ("m", "amen", 1), ("th", "th", 0)}
    assert J.contains_join(rules, names, most=1).count() == 3


def test_checked_join(spark):
    a, b = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z")], "k int, v string"), spark.createDataFrame([(1, 10)], "k int, w int")
    assert J.checked_join(a, b, ["k"]).count() == 3
    for call in (lambda: J.checked_join(b, a, ["k"]), lambda: J.checked_join(a, b, ["k"], "one_to_one"), lambda: J.checked_join(a, b, ["k"], complete=True)):
        with pytest.raises(ValueError):
            call()


def scored(spark, pairs):
    return spark.createDataFrame(pairs, "score double, label int")


def test_curves_against_brute_force(spark):
    rng = random.Random(2)
    pairs = [(rng.choice([0.1, 0.2, 0.35, 0.5, 0.9]), rng.randrange(2)) for _ in range(60)]
    df = scored(spark, pairs)
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert abs(metrics.roc_auc(df).first().roc_auc - auc) < 1e-12
    ap, last = 0.0, 0.0
    best = (-1, 0)
    for t in sorted({s for s, _ in pairs}, reverse=True):
        tp, fp = sum(p >= t for p in pos), sum(n >= t for n in neg)
        ap += (tp / len(pos) - last) * tp / (tp + fp)
        last = tp / len(pos)
        best = max(best, (round(2 * tp / (tp + fp + len(pos)), 12), -t))
    assert abs(metrics.average_precision(df).first().average_precision - ap) < 1e-12
    got = metrics.best_f1(df).first()
    assert (got.f1, got.threshold) == (best[0], -best[1])
    cuts = sorted({s for s, _ in pairs})
    cands = [cuts[0] - 1e-9, *[(a + b) / 2 for a, b in itertools.pairwise(cuts)], cuts[-1] + 1e-9]
    judged = []
    for t in cands:
        tp, fp = sum(p >= t for p in pos), sum(n >= t for n in neg)
        judged.append((round((tp / len(pos) + 1 - fp / len(neg)) / 2, 9), round(2 * tp / (tp + fp + len(pos)) if tp + fp + len(pos) else 0, 9), -t))
    fit = metrics.fit_threshold(df).first()
    assert abs(fit.threshold + max(judged)[2]) < 1e-9 and fit.balanced_accuracy == max(judged)[0]


def test_metrics_of_one_class_and_none(spark):
    one = scored(spark, [(0.5, 1), (0.7, 1)])
    assert metrics.roc_auc(one).first().roc_auc is None
    assert metrics.roc_auc(one.limit(0)).first().roc_auc is None
    r = metrics.confusion(one, 0.6).first()
    assert (r.tp, r.fn, r.specificity, r.mcc) == (1, 1, 0, 0)


def test_published_confusion_identity(spark):
    counts = spark.createDataFrame([(90, 5, 95, 10)], "tp long, fp long, tn long, fn long")
    r = metrics.with_rates(counts).first()
    assert abs(r.accuracy - 0.925) < 1e-12 and abs(r.f1 - 180 / 195) < 1e-12 and abs(r.mcc - (90 * 95 - 50) / (95 * 100 * 100 * 105) ** 0.5) < 1e-12


def test_running_totals_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("o"), F.col("id").alias("v"))
    rows = metrics.running_totals(df, "o", ["v"]).orderBy("o").collect()
    assert [r.cum_v for r in rows] == np.cumsum([r.v for r in rows]).tolist()


def test_digest_depends_on_order(spark):
    df = spark.range(3000).select("id", (F.col("id") * 3).alias("v"))
    a = metrics.ordered_digest(df, "id", ["v"]).first().digest
    assert a == metrics.ordered_digest(df.repartition(5), "id", ["v"]).first().digest
    assert a != metrics.ordered_digest(df.withColumn("id", 2999 - F.col("id")), "id", ["v"]).first().digest


def greedy(wishes, taken=()):
    used, out = set(taken), {}
    for row in sorted(wishes):
        for key in wishes[row]:
            if key not in used:
                used.add(key)
                out[row] = key
                break
    return out


@pytest.mark.parametrize("seed", range(4))
def test_assignment_equals_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    wishes = {r: rng.sample(range(25), rng.randrange(1, 7)) for r in range(30)}
    df = spark.createDataFrame([(r, p, str(k)) for r, ks in wishes.items() for p, k in enumerate(ks)], "row_idx long, pref int, key string")
    taken = spark.createDataFrame([("3",), ("4",)], "key string")
    got = {r.row_idx: int(r.key) for r in assignment.assign_unique(df, taken).collect()}
    assert got == greedy(wishes, {3, 4})
    later = {r: [rng.randrange(25, 35)] for r in wishes}
    more = spark.createDataFrame([(r, 1, str(k)) for r, ks in later.items() for k in ks], "row_idx long, pref int, key string")
    both = {r.row_idx: (int(r.key), r.phase) for r in assignment.assign_in_phases(df, more, taken=taken).collect()}
    first = greedy(wishes, {3, 4})
    second = greedy({r: k for r, k in later.items() if r not in first}, first.values())
    assert both == {r: (k, 1) for r, k in first.items()} | {r: (k, 2) for r, k in second.items()}
    cut = [r.row_idx for r in assignment.first_in_visits(df, 5).collect()]
    assert cut == sorted(greedy(wishes))[:5]


def test_matched_negatives(spark):
    neg = spark.createDataFrame([(k, k % 3, k % 2) for k in range(60)], "id long, b1 int, b2 int")
    pos = spark.createDataFrame([("train", 0, 0)] * 15 + [("test", 2, 1)] * 10, "split string, b1 int, b2 int")
    rows = assignment.matched_negatives(neg, pos).collect()
    assert Counter(r.split for r in rows) == {"train": 15, "test": 10} and len({r.id for r in rows}) == 25
    assert sum((r.b1, r.b2) == (0, 0) for r in rows if r.split == "train") == 10
    assert assignment.plan_allocation({(0, 0): 1, (5, 5): 9}, [("a", (0, 0), 3)]) == [("a", 0, 0, 1, 1), ("a", 5, 5, 1, 2)]


def test_swaps(spark):
    got = {(r.swap_i, r.swapped) for r in generators.adjacent_swaps(names_df(spark, ["facebook", "short"])).collect()}
    assert got == {(2, "faecbook"), (3, "facbeook"), (4, "faceobok"), (6, "faceboko")}
    rows = spark.createDataFrame([("google", "gogole"), ("ab", "ba"), ("abcd", "abdc"), ("abcd", "abxd")], "a string, b string").select(generators.infer_swap(F.col("a"), F.col("b")).alias("i")).collect()
    assert [r.i for r in rows] == [2, None, 2, None]


RULES = {"multichar_forward": [{"source": "m", "replacement": "rn", "score": 4.0, "operation": "m_to_rn"}], "ocr": [{"source": "o", "replacement": "0", "score": 4.0, "operation": "o_to_0"}], "exact": [{"source": "i", "replacement": "і", "score": 5.0, "operation": "i"}], "adjacent": [{"real_name": "mcdonalds", "swap_i": 3, "score": 2.0}]}


def test_generated_operations_replay(spark):
    names = spark.createDataFrame([(k, n) for k, n in enumerate(["mcdonalds", "moon", "moon", "moon", "xyz", "bim"])], "row_idx long, name string")
    plans = names.withColumn("attempt_seed", F.lit(5)).withColumns({f: F.lit(1) for f in generators.FAMILIES})
    rows = generators.generate_unique(names, plans, RULES, tries=16).collect()
    assert len({r.generated.lower() for r in rows}) == len(rows) and {r.name for r in rows} == {"mcdonalds", "moon", "bim"}
    for r in rows:
        text = r.name
        for o in r.operations:
            assert o.before == text
            text = text[: o.position] + o.replacement + text[o.position + len(o.source) :]
            assert o.after == text
        assert text == r.generated != r.name


def test_unique_variants_beyond_the_first_hundreds(spark):
    names = spark.createDataFrame([(k, "o" * 12) for k in range(3)], "row_idx long, name string")
    plans = names.withColumn("attempt_seed", F.lit(5)).withColumns({f: F.lit(1) for f in generators.FAMILIES})
    legal = generators.legal_variants(names.limit(1), RULES).orderBy("pref").select("generated").toPandas().generated.tolist()
    assert len(legal) == 793
    taken = spark.createDataFrame([(v,) for v in legal[:600]], "key string")
    rows = generators.generate_unique(names, plans, RULES, taken).orderBy("row_idx").collect()
    assert [(r.row_idx, r.generated, r.phase) for r in rows] == [(k, legal[600 + k], 2) for k in range(3)]
    assert [r.row_idx for r in generators.generate_unique(names, plans, RULES, taken, most=602).orderBy("row_idx").collect()] == [0, 1]


def test_unique_variants_equal_the_sequential_rule(spark):
    names = spark.createDataFrame([(k, ["moon", "bim", "moo"][k % 3]) for k in range(24)], "row_idx long, name string")
    plans = names.withColumn("attempt_seed", F.col("row_idx")).withColumns({f: F.lit(1) for f in generators.FAMILIES})
    wishes = [{}, {}]
    for r in generators.spelled(plans, RULES).filter("valid").collect():
        wishes[0].setdefault(r.row_idx, []).append((1, r.generated.lower()))
    for k, made in enumerate((generators.fallbacks(names, RULES), generators.legal_variants(names, RULES))):
        for r in made.collect():
            wishes[k].setdefault(r.row_idx, []).append((r.pref, r.generated.lower()))
    want, used = {}, {"moon", "bim", "moo"}
    for phase, of in enumerate(wishes, 1):
        for k in sorted(of):
            free = [key for _, key in sorted(of[k]) if key not in used]
            if k not in want and free:
                want[k] = (free[0], phase)
                used.add(free[0])
    got = {r.row_idx: (r.generated.lower(), r.phase) for r in generators.generate_unique(names, plans, RULES).collect()}
    assert got == want and {p for _, p in want.values()} == {1, 2} and len(want) < 24


def test_edit_variants(spark):
    rules = spark.createDataFrame([("ocr", "o", "0", 4.0, 10, "o"), ("multichar_forward", "m", "rn", 3.0, 50, "m")], "family string, source string, replacement string, score double, priority int, operation string")
    got = [(r.generated, r.distance) for r in generators.edit_variants(generators.candidate_edits(names_df(spark, ["moo", "xyz"]), rules)).orderBy("rank").collect()]
    assert set(got) == {("m0o", 1), ("mo0", 1), ("rnoo", 2), ("m00", 2), ("rn0o", 3), ("rno0", 3)} and got[:2] == [("m0o", 1), ("mo0", 1)]
    two = generators.edit_variants(generators.candidate_edits(names_df(spark, ["moo"]), rules), preferred=2).orderBy("rank").first()
    assert two.distance == 2


def test_count_plans_keep_their_limits(spark):
    names = spark.createDataFrame([(k, n) for k, n in enumerate(["oil", "oilcompany", "averylongcompanyname"] * 30)], "row_idx long, name string")
    params = {"short_max": 4, "medium_max": 10, "short": (1, 2), "medium": (0.1, 0.5), "long": (0.1, 0.5), "skew": "high", "least": 1, "most": 3, "caps": dict.fromkeys(generators.FAMILIES, 2), "chances": dict.fromkeys(generators.FAMILIES, 0.8), "ocr_share": 0.65, "replaceable": "oia", "seed": 1}
    rows = generators.count_plans(names, params).collect()
    assert all(r.ocr + r.exact <= 3 and r.ocr <= 2 and r.exact <= 2 for r in rows)
    assert all(r.adjacent == 0 for r in rows if len(r.name) < 8) and {r.bucket for r in rows} == {"short", "medium", "long"}
    assert rows == generators.count_plans(names, params).collect()


def test_sampling(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 4 == 0).cast("int").alias("label"))
    held = sampling.holdout(df, "label", "id", 0.1, 3).groupBy("label").agg(F.sum(F.col("held_out").cast("int")).alias("n")).collect()
    assert {r.label: r.n for r in held} == {0: 75, 1: 25}
    a, b = ({r.id for r in sampling.sample_rows(x, 50, 1, "id").collect()} for x in (df, df.repartition(7)))
    assert a == b and len(a) == 50
    assert sampling.sample_with_replacement(df, 200, 1, "id").count() == 200 and sampling.sample_with_replacement(df.limit(0), 5, 1, "id").count() == 0
    pools = {r.pool: r["count"] for r in sampling.name_pools(df, "id", {"train": 0.8, "test": 0.1, "validation": 0.1}, 2).groupBy("pool").count().collect()}
    assert pools == {"train": 800, "test": 100, "validation": 100}
    w = spark.range(1).select(sampling.softmax_weights(F.array(F.lit(2.0), F.lit(2.0), F.lit(1.0)), 0.0).alias("w")).first().w
    assert w == [0.5, 0.5, 0.0]
    assert sampling.split_plan(101, 21, 0.25)["validation"] == {"rows": 21, "positive_rows": 11, "negative_rows": 10}
    assert sampling.rebalanced_plan({"train": 5, "test": 1, "validation": 9}, 4, 0.25)["test"]["rows"] == 2


def test_softmax_choice_follows_the_weights(spark):
    df = spark.range(6000).select((F.col("id") / 3).cast("int").alias("g"), F.col("id").alias("k"), (F.col("id") % 3).cast("double").alias("s"))
    got = Counter(r.s for r in sampling.softmax_choice(df, ["g"], "k", "s", 1.0, 4).collect())
    want = np.exp([0, 1, 2]) / np.exp([0, 1, 2]).sum()
    assert all(abs(got[k] / 2000 - want[k]) < 0.05 for k in range(3))
    assert {r.s for r in sampling.softmax_choice(df, ["g"], "k", "s", 0.0, 4).collect()} == {2.0}


def test_random_draws(spark):
    df = spark.range(300).withColumnRenamed("id", "seed")
    rows = sampling.random_draws(df, "int", 2, 5, "seed", skew="low").collect()
    assert {r.value for r in rows} == {2, 3, 4, 5} and rows == sampling.random_draws(df, "int", 2, 5, "seed", skew="low").collect()
    assert {r.value for r in sampling.random_draws(df, "binomial", 0, 0, "seed", times=3, chance=1.0).collect()} == {3}


def test_ranking(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 2.0), ("b", 3, 1.0)], "g string, i int, s double")
    assert sorted(map(tuple, ranking.first_per_key(df, ["g"], [-F.col("s"), F.col("i")]).collect())) == [("a", 1, 2.0), ("b", 3, 1.0)]
    assert sorted(map(tuple, ranking.last_per_key(df, ["g"], [F.col("s"), F.col("i")]).collect())) == [("a", 2, 2.0), ("b", 3, 1.0)]
    pts = spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, 5.0), (3, 2.0, 7.0), (4, 3.0, 9.0), (5, 2.0, 5.0)], "id int, x double, y double")
    assert sorted(r.id for r in ranking.pareto_frontier(pts, ["x"], ["y"]).collect()) == [2, 4, 5]
    assert ranking.bucketed_choice(pts, F.col("x") > 100, ["x"], [F.col("y"), F.col("id")]).first().id == 1
    pools = {r.k: r.p for r in ranking.disjoint_pools(spark.createDataFrame([("x", "train"), ("x", "test"), ("y", "other")], "k string, p string"), "k", "p", ["validation", "test", "train"]).collect()}
    assert pools == {"x": "test", "y": "train"}


def test_frontier_against_all_pairs(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(k, rng.randrange(30), rng.randrange(30), rng.randrange(4)) for k in range(700)]
    beats = lambda p, q: p[1] >= q[1] and p[2] <= q[2] and p[3] <= q[3] and p[1:] != q[1:]
    want = sorted(r[0] for r in rows if not any(beats(p, r) for p in rows))
    for block in (20_000, 3):
        monkeypatch.setattr(ranking, "FRONTIER_BLOCK", block)
        df = spark.createDataFrame([*rows, (900, None, 0, 0)], "id long, x long, y long, z long").repartition(5)
        assert sorted(r.id for r in ranking.pareto_frontier(df, ["x"], ["y", "z"]).collect()) == want


def test_a_crash_between_renames_loses_nothing(spark, tmp_path):
    path = str(tmp_path / "table")
    registry.write_upserted(spark, path, spark.createDataFrame([("a", 1)], "key string, at int"), ["key"], "at")
    os.rename(path, path + ".old")
    registry.write_upserted(spark, path, spark.createDataFrame([("b", 1)], "key string, at int"), ["key"], "at")
    assert sorted(r.key for r in spark.read.parquet(path).collect()) == ["a", "b"] and not os.path.exists(path + ".old")


def test_two_nearest_sources_in_blocks(spark, monkeypatch):
    rng = random.Random(9)
    vector = lambda: [rng.uniform(-1, 1) for _ in range(3)]
    sources = spark.createDataFrame([(k, vector()) for k in range(9)], "source long, vector array<double>")
    points = spark.createDataFrame([(k, vector()) for k in range(40)], "id long, vector array<double>")
    one = sorted(map(tuple, J.similar_to_sources(sources, points, 0.2).collect()))
    monkeypatch.setattr(J, "BLOCK_ROWS", 2)
    assert one and sorted(map(tuple, J.similar_to_sources(sources, points, 0.2).collect())) == one


def test_registry(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, 0.1), ("b", 5, 0.2)], "key string, at int, v double")
    new = spark.createDataFrame([("a", 1, 0.3), ("b", 2, 0.4), ("c", 0, 0.5)], "key string, at int, v double")
    assert sorted(map(tuple, registry.upsert(old, new, ["key"], "at").collect())) == [("a", 1, 0.3), ("b", 5, 0.2), ("c", 0, 0.5)]
    path = str(tmp_path / "table")
    registry.write_upserted(spark, path, old, ["key"], "at")
    registry.write_upserted(spark, path, new, ["key"], "at")
    assert spark.read.parquet(path).count() == 3
    asked = spark.createDataFrame([("x",), ("yy",), ("x",)], "k string")
    memo = spark.createDataFrame([("x", 9.0)], "k string, score double")
    got, grown, n = registry.scored_with_memo(asked, memo, ["k"], lambda df: df.withColumn("score", F.length("k").cast("double")))
    assert sorted(r.score for r in got.collect()) == [2, 9, 9] and grown.count() == 2 and n == {"requested": 2, "missing": 1}
    rows = registry.grid_search([{"x": 1}, {"x": 0}], lambda p: {"y": 1 / p["x"]}, {"y": -1.0})
    assert rows[0]["y"] == 1 and rows[1]["y"] == -1 and "ZeroDivisionError" in rows[1]["error"]


def test_checks(spark):
    bad = spark.createDataFrame([("a.com", "a", 1.0), ("", "b", 0.0), ("c", "c", 2.0)], "fraudulent_name string, real_name string, label double")
    r = checks.pair_violations(bad).first()
    assert (r.bad_labels, r.empty_names, r.dot_com) == (1, 1, 1)
    with pytest.raises(ValueError):
        checks.require_none(checks.pair_violations(bad))
    assert checks.cleaned_pairs(bad, drop_empty=True).count() == 2 and checks.cleaned_pairs(bad, as_negatives=True).count() == 1
    with pytest.raises(ValueError):
        checks.quality_gates({"auc": 0.97}, {})
    assert checks.quality_gates({"auc": 0.9}, {"auc": 0.85}, warn=True) and not checks.quality_gates({"auc": 0.86}, {"auc": 0.85})
    same = checks.compared(bad, bad, "real_name").first()
    assert tuple(same) == (0, 0, 0)


def test_forest_separates(spark):
    words = ["alphabet", "betatron", "gammaray", "deltawing", "epsilons", "zetafunc", "etamesons", "thetawave"] * 4
    rows = [(w + str(k), w + str(k) + "x", 1.0, f"p{k}") for k, w in enumerate(words)] + [(w + str(k), w[::-1], 0.0, f"n{k}") for k, w in enumerate(words)]
    got = forest.held_out_scores(spark.createDataFrame(rows, "real_name string, fraudulent_name string, label double, id string"), "id", share=0.25, trees=10)
    assert metrics.roc_auc(got).first().roc_auc > 0.95
    assert full_damerau("ab", "ba") == 1


def test_registered_forest_has_the_size_of_the_reference(spark, sf, monkeypatch):
    from simloom.plans import catalog

    sizes, train = [], forest.train
    monkeypatch.setattr(forest, "train", lambda pairs, **options: sizes.append((pairs.count(), options["trees"])) or train(pairs, **(options | {"trees": 2})))
    held = catalog.queries()["rf_text_features"](spark, sf).count()
    assert sizes[0][1] == 400 and held == round(0.1 * (held + sizes[0][0]))
