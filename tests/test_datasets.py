"""Dataset construction against plain sequential code."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from simloom.functions import text as X
from simloom.operators import datasets as S
from simloom.operators import generators


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def digest(*parts):
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()


def uniform(*parts):
    return (int(digest(*parts)[:13], 16) + 0.5) / 2**52


def some_names(seed, n, letters="abcd", most=12):
    rng = random.Random(seed)
    out = {"".join(rng.choice(letters) for _ in range(rng.randrange(2, most))) for _ in range(n)}
    return sorted(out | {"x" * 30, "x" * 30 + "y" * 9, "shop.com", "z" * 60})


def frame(spark, names):
    return spark.createDataFrame([(n, n.upper()) for n in names], "name string, key string")


def test_visits(spark):
    pool = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "name string, place long")
    for count in (1, 3, 7):
        assert sorted(map(tuple, S.visits(pool, count).collect())) == [(k, "abc"[k % 3]) for k in range(count)]


def test_positives_to_count(spark):
    rng = random.Random(1)
    names = ["ab", "bc", "cd", "de", "none"]
    pool = [(n, n.upper(), k) for k, n in enumerate(names)]
    variants = []
    for n in names[:4]:
        for pref in (1, 2) if n != "cd" else (1,):
            keys = rng.sample(range(14), 8)
            variants += [(n, pref, r, f"v{k}", n.upper() if k == 3 else f"V{k}") for r, k in enumerate(keys)]
    taken = {"V5"}
    want, used, row = [], set(taken), 0
    of = lambda n, p: sorted((r, g, k) for m, q, r, g, k in variants if (m, q) == (n, p))
    while len(want) < 9:
        n = names[row % 5]
        p = 2 if uniform(0, row) < 0.65 and of(n, 2) else 1
        for _, g, k in of(n, p):
            if k not in used and k != n.upper():
                used.add(k)
                want.append((row, n, p, g, k))
                break
        row += 1
    args = spark.createDataFrame(pool, "name string, key string, place long"), spark.createDataFrame(variants, "name string, preferred int, rank int, generated string, key string")
    got = S.positives_to_count(*args, 9, taken=spark.createDataFrame([("V5",)], "key string"))
    assert sorted(map(tuple, got.collect())) == want
    with pytest.raises(ValueError, match="positives after"):
        S.positives_to_count(*args, 40, attempts=2)


def test_edits_of_stored_names_are_not_broadcast(spark, tmp_path):
    """Lists of edits are many times the stored names that Spark estimates them by."""
    spark.createDataFrame([("amazon",), ("zzz",)], "name string").write.parquet(str(tmp_path / "names"))
    rules = spark.createDataFrame([("ocr", "m", "rn", 1.0, 10, "replace")], "family string, source string, replacement string, score double, priority int, operation string")
    edited = generators.candidate_edits(spark.read.parquet(str(tmp_path / "names")), rules)
    assert {(r.name, len(r.edits)) for r in edited.collect()} == {("amazon", 1), ("zzz", 0)}
    assert "LeftOuter, Build" not in edited._jdf.queryExecution().executedPlan().toString()


def brute_expanding(asked, names, reach):
    first = {}
    for n in sorted(names):
        if ".com" not in n:
            first.setdefault(n.upper(), n)
    out, used = [], set()
    for row, real, goal in sorted(asked):
        for cutoff, window in ((reach, 5), (reach + 2, 8), (reach + 6, 12), (64, 64)):
            near = sorted((edit(real, n), len(n), n, k) for k, n in first.items() if abs(len(n) - len(real)) <= window)
            usable = [x for x in near if x[0] <= cutoff and x[3] != real.upper() and (real, x[3]) not in used][:64]
            if usable:
                break
        else:
            continue
        exact = [x for x in usable if x[0] == goal]
        options = (exact or sorted(usable, key=lambda x: (abs(x[0] - goal), x[0], x[2])))[:32]
        d, _, n, k = options[int(uniform(0, row) * len(options))]
        used.add((real, k))
        out.append((row, real, n, d, "exact_target" if exact else "nearest_available"))
    return out


def test_expanding_negatives_against_brute_force(spark):
    names = some_names(2, 90)
    rng = random.Random(3)
    asked = [(k, rng.choice([*names[:40], "x" * 30, "z" * 60]), rng.choice([1, 2])) for k in range(150)] + [(150 + k, "z" * 60, 1) for k in range(100)]
    rows = spark.createDataFrame([(r, n, n.upper(), g) for r, n, g in asked], "row_idx long, name string, key string, goal int")
    got = S.expanding_negatives(rows, frame(spark, names))
    assert sorted(map(tuple, got.collect())) == brute_expanding(asked, names, 4)


def brute_distance(rows, names, reach, taken):
    first = {}
    for n in sorted(names):
        if ".com" not in n:
            first.setdefault(n.upper(), n)
    used, out, left = set(taken), {}, sorted(rows)
    for radius in (reach, reach + 8):
        for row, real, goal in list(left):
            near = [(edit(real, n), n, k) for k, n in first.items() if k != real.upper() and k not in used]
            near = sorted((max(d, goal), abs(d - goal), digest(0, real, k), n, k, d) for d, n, k in near if d <= radius)
            if near:
                at, _, _, n, k, d = near[0]
                used.add(k)
                left.remove((row, real, goal))
                out[row] = (row, real, n, d, "exact_target" if d == goal else f"nearest_fallback_radius_{at}")
    return out, left


def test_distance_negatives_against_brute_force(spark):
    names = some_names(4, 80)
    rows = [(k, n, 1 + k % 2) for k, n in enumerate(names[:30] + names[:8])]
    df = spark.createDataFrame([(r, n, n.upper(), g) for r, n, g in rows], "row_idx long, name string, key string, goal int")
    taken = spark.createDataFrame([(names[5].upper(),)], "key string")
    want, left = brute_distance(rows, names, 4, {names[5].upper()})
    got = {r.row_idx: tuple(r) for r in S.distance_negatives(df, frame(spark, names), taken=taken).collect()}
    assert {k: v for k, v in got.items() if not v[4].startswith("global")} == want
    assert sorted(k for k, v in got.items() if v[4] == "global_length_fallback") == sorted(r[0] for r in left)
    assert len({v[2].upper() for v in got.values()}) == len(got)


def test_distance_trials(spark):
    names = some_names(5, 60)
    rows = spark.createDataFrame([(k, n, n.upper()) for k, n in enumerate(names[:20])], "row_idx long, name string, key string")
    got = S.distance_trials(rows, frame(spark, names)).collect()
    assert {r.policy for r in got} == set(S.POLICIES)
    for p in S.POLICIES:
        assert sum(r.n for r in got if r.policy == p) == 20
    near = {p: sum(r.n for r in got if r.policy == p and r.mode == "exact_target" and r.distance == 1) for p in S.POLICIES}
    assert near["neg_d1"] > near["neg_d2"] == 0


def test_hard_negatives_against_brute_force(spark):
    names = some_names(6, 50)
    rows = [(k, n, n.upper()) for k, n in enumerate(names[:24])]
    near = [(n, m, m.upper(), r) for _, n, _ in rows[:15] for r, m in enumerate(sorted((x for x in names if x != n and ".com" not in x), key=lambda x: (edit(x, n), x))[:3], 1)]
    positives = [(k, float(k % 3), float(k), float(k * k % 5)) for k in range(7)]
    features = {(a, b): (float(len(a) - len(b)), float(a[0] == b[0])) for a in names for b in names}

    def featured(pairs):
        return pairs.withColumn("f", (F.length("name") - F.length("candidate")).cast("double")).withColumn("g", (F.substring("name", 1, 1) == F.substring("candidate", 1, 1)).cast("double")).withColumn("distance", F.levenshtein("name", "candidate").cast("double"))

    got = S.hard_negatives(
        spark.createDataFrame(rows, "row_idx long, name string, key string"), spark.createDataFrame(near, "name string, neighbor string, neighbor_key string, rank int"),
        frame(spark, names), spark.createDataFrame(positives, "id long, distance double, f double, g double"), ["f", "g"], featured, spare=200,
    )
    got = {r.row_idx: (r.neighbor, r.mode) for r in got.collect()}
    used, want, late = set(), {}, []
    for row, n, k in rows:
        free = [m for a, m, mk, _ in near if a == n and mk not in used and mk != k]
        if free:
            used.add(free[0].upper())
            want[row] = (free[0], "nearest_neighbor_table")
        else:
            late.append((row, n, k))
    for row, n, k in late:
        _, d, f, g = positives[int(uniform(0, row) * 7)]
        lengths = [m for m in names if m != n and ".com" not in m and abs(len(m) - len(n)) <= 4 and m.upper() not in used and m.upper() != k]
        score = lambda m: round(((features[n, m][0] - f) ** 2 + (features[n, m][1] - g) ** 2) ** 0.5 + 0.15 * abs(edit(n, m) - d), 9)
        if lengths:
            best = min(lengths, key=lambda m: (score(m), m))
            used.add(best.upper())
            want[row] = (best, "feature_fallback")
    assert {k: v for k, v in got.items() if k in want} == want


def test_combined_rules(spark):
    manual = spark.createDataFrame([("o", "0", "o", None), ("l", "1", "l", None), ("l", "l", "l", None), ("ab", "c", "a", None)], "source_character string, replacement_character string, primary_sub string, review_label string")
    ranked = spark.createDataFrame([("o", "0", 0.9, 30.0, 3.0, "keep", None), ("e", "3", 0.5, 2.0, None, None, "ocr_confusable"), ("e", "€", 0.1, 0.0, None, None, None), ("x", "y", 1.0, 9.0, 5.0, "drop", None), ("q", "g", 1.0, 9.0, 5.0, None, "other")], "real_span string, candidate_span string, visual_similarity_score double, ocr_attack_contexts double, legit_q25 double, review_label string, substitution_family string")
    got = S.combined_rules([(manual, "manual_user_x"), (ranked, "ranked")], spark.createDataFrame([("l", "1")], "source_character string, replacement_character string"), 2.0).collect()
    assert sorted((r.source_character, r.replacement_character, r.source, round(r.generation_score, 6), r.replacement_codepoint) for r in got) == [("e", "3", "ranked", 7.0, "U+0033"), ("o", "0", "ranked", 79.0, "U+0030")]


def test_first_replacements(spark):
    rows = [("a", None, 1.0, 0.9), ("a", "x", 2.0, 0.1), ("a", "y", 2.0, 0.5), ("b", "z", None, 0.5), ("b", "w", 9.0, 0.5), ("c", None, 1.0, 1.0)]
    got = S.first_replacements(spark.createDataFrame(rows, "source_character string, replacement_character string, source_rank double, visual_similarity_score double"))
    assert sorted(map(tuple, got.collect())) == [("a", "y"), ("b", "w")]


def test_labels_and_table_normalizer(spark):
    values = ["1", "0.0", " 1 ", "2", "nan", "x", None, "1e0", ""]
    got = [r.v for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, s string").orderBy("k").select(X.binary_label(F.col("s")).alias("v")).collect()]
    assert got == [1.0, 0.0, 1.0, None, None, None, None, 1.0, None]
    normalize = X.table_normalizer({"0": "q", "ı": "i"}, {"0": "o", "ß": "b"})
    texts = ["Ab 0-\t9!", "ﬁne ß", "½", "ıÉ　x", None, "", "漢a"]
    got = [r.v for r in spark.createDataFrame([(k, v) for k, v in enumerate(texts)], "k long, s string").orderBy("k").select(normalize(F.col("s")).alias("v")).collect()]
    assert got == ["abo-9", "fineb", "12", "iex", None, "", "a"]


def test_codepoint_names(spark):
    rows = spark.createDataFrame([("a",), ("і",), ("\x07",), ("",), (None,)], "s string").select(X.codepoint_name(F.col("s")).alias("v")).collect()
    assert [r.v for r in rows] == ["LATIN SMALL LETTER A", "CYRILLIC SMALL LETTER BYELORUSSIAN-UKRAINIAN I", "U+0007", None, None]
