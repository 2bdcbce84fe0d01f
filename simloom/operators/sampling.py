"""Sampling by hashes of keys: the same rows in every run, on any partitioning."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simloom.functions.text import hash_order, hash_uniform
from simloom.operators.metrics import running_totals


def shuffled(df: DataFrame, seed: int, key: str) -> DataFrame:
    return df.orderBy(hash_order(seed, F.col(key)), key)


def sample_rows(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows without replacement, in their own order."""
    return df.orderBy(hash_order(seed, F.col(key)), key).limit(n).orderBy(key)


def sample_with_replacement(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n draws; draw d takes the row whose number is a hash of d modulo the rows."""
    rows = df.count()
    if not rows:
        return df.withColumn("draw", F.lit(None).cast("long"))
    numbered = running_totals(df.withColumn("_one", F.lit(1)), key, ["_one"]).withColumn("_n", F.col("cum__one") - 1)
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), F.floor(hash_uniform(seed, F.col("id")) * rows).alias("_n"))
    return draws.join(numbered, "_n").select("draw", *df.columns)


def holdout(df: DataFrame, label: str, key: str, share: float, seed: int) -> DataFrame:
    """df with held_out: of each label the rounded share (one row at least, if there are two), by hash order.

    Rows below the quota are found by a count over hash prefixes, so that no task sorts a whole label.
    """
    h = hash_order(seed, F.col(key))
    marked = df.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, 3))
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_all"))
    quota = F.when(F.col("_all") < 2, 0).otherwise(F.greatest(F.lit(1), F.bround(F.col("_all") * share))).cast("long")
    buckets = marked.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = buckets.withColumn("_before", before).join(sizes.withColumn("_quota", quota), label).select(label, "_b", "_before", "_quota")
    inner = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", key))
    return marked.withColumn("_n", inner).join(buckets, [label, "_b"]).withColumn("held_out", F.col("_before") + F.col("_n") <= F.col("_quota")).select(*df.columns, "held_out")


def class_cap(df: DataFrame, label: str, key: str, total: int, seed: int) -> DataFrame:
    """At most total // classes rows of each label, by hash order."""
    each = total // max(1, df.select(label).distinct().count())
    order = Window.partitionBy(label).orderBy(hash_order(seed, F.col(key)), key)
    return df.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= each).drop("_n")


def softmax_choice(df: DataFrame, by: list[str], key: str, score: str, temperature: float, seed: int) -> DataFrame:
    """One row of each group, drawn by softmax(score / temperature) with Gumbel noise; at 0 evenly from the best ones."""
    u = hash_uniform(seed, *[F.col(c) for c in by], F.col(key))
    rank = F.struct(F.col(score).alias("s"), u.alias("u")) if temperature <= 0 else F.struct((F.col(score) / temperature - F.log(-F.log(u))).alias("s"), u.alias("u"))
    row = F.struct(*[c for c in df.columns if c not in by])
    return df.groupBy(*by).agg(F.max_by(row, rank).alias("_r")).select(*by, "_r.*").select(*df.columns)


def softmax_weights(scores: Column, temperature: float) -> Column:
    """Weights of an array of scores; at temperature 0 or less even over the best ones."""
    top = F.array_max(scores)
    if temperature <= 0:
        raw = F.transform(scores, lambda s: F.when(F.abs(s - top) <= 1e-9 * F.greatest(F.abs(s), F.abs(top)), 1.0).otherwise(0.0))
    else:
        raw = F.transform(scores, lambda s: F.exp((s - top) / temperature))
    total = F.aggregate(raw, F.lit(0.0), lambda a, v: a + v)
    return F.transform(raw, lambda v: v / total)


def name_pools(df: DataFrame, key: str, shares: dict[str, float], seed: int) -> DataFrame:
    """df with pool: keys in hash order, cut at the running shares; the last pool takes the rest."""
    total = df.count()
    numbered = running_totals(df.withColumn("_h", hash_order(seed, F.col(key))).withColumn("_one", F.lit(1)), "_h", ["_one"])
    pool, cut = F.lit(None).cast("string"), 0
    names = list(shares)
    whole = sum(shares.values()) or 1.0
    for k, name in enumerate(names[:-1]):
        n = min(max(1, round(total * shares[name] / whole)), total - cut - (len(names) - k - 1))
        cut += max(0, n)
        pool = F.when(pool.isNotNull(), pool).when(F.col("cum__one") <= cut, name)
    return numbered.withColumn("pool", F.coalesce(pool, F.lit(names[-1]))).select(*df.columns, "pool")


def split_plan(negatives: int, validation: int, test_to_train: float) -> dict[str, dict[str, int]]:
    """Rows, positives and negatives of each split, balanced overall; halves round to even."""
    total = 2 * negatives
    v = min(validation, total)
    v_pos = v - v // 2
    t = round((total - v) * test_to_train / (1 + test_to_train))
    plan = {"validation": (v_pos, v - v_pos), "test": (t // 2, t - t // 2)}
    plan["train"] = (negatives - v_pos - t // 2, negatives - (v - v_pos) - (t - t // 2))
    return {s: {"rows": p + n, "positive_rows": p, "negative_rows": n} for s, (p, n) in plan.items()}


def rebalanced_plan(generated: dict[str, int], validation: int, test_to_train: float) -> dict[str, dict[str, int]]:
    """The plan for what was generated: no split has more positives than it got, and as many negatives."""
    plan = split_plan(sum(generated.values()), validation, test_to_train)
    capped = {s: min(p["positive_rows"], generated[s]) for s, p in plan.items()}
    return {s: {"rows": 2 * n, "positive_rows": n, "negative_rows": n} for s, n in capped.items()}


#: Parameters of the Beta distribution for each skew.
SKEWS = {"low": (1.0, 3.0), "high": (3.0, 1.0), "middle": (2.5, 2.5)}


def random_draws(df: DataFrame, kind: str, low: float, high: float, seed_column: str, out: str = "value", skew: str = "", times: int = 1, chance: float = 0.5) -> DataFrame:
    """df with a draw for each row, seeded by a column: kind is int, float (both between low and high, skewed by
    low, high, middle or nothing, through Beta draws) or binomial (of `times`, with `chance`)."""
    import numpy as np

    def one(seed: int) -> float:
        rng = np.random.default_rng(seed)
        if kind == "binomial":
            p = min(1.0, max(0.0, chance))
            return float(times if p >= 1 else rng.binomial(max(0, times), p))
        if high <= low:
            return float(low)
        x = low + (rng.beta(*SKEWS[skew]) if skew in SKEWS else rng.random()) * (high - low)
        return float(round(x)) if kind == "int" else float(x)

    def draw(batches):
        for pdf in batches:
            yield pdf.assign(**{out: pd.Series([one(int(s)) for s in pdf[seed_column]], dtype=float)})

    return df.mapInPandas(draw, f"{', '.join(f'`{n}` {t}' for n, t in df.dtypes)}, {out} double")


def substituted_at_random(df: DataFrame, rules: dict[str, str], most: int, seed: int) -> DataFrame:
    """name with up to `most` characters, drawn by hash from those with a rule, replaced; unchanged rows go. df: id, name."""
    table = F.create_map(*[x for k, v in rules.items() for x in (F.lit(k), F.lit(v))])
    places = F.filter(F.transform(F.split("name", ""), lambda c, i: F.struct(F.sha2(F.concat_ws("|", F.lit(seed), F.col("id"), i).cast("binary"), 256).alias("h"), i.alias("i"), c.alias("c"))), lambda s: F.map_contains_key(table, s["c"]))
    # folded over the few picked places, so that they are worked out once and not for each character
    new = F.aggregate(F.array_sort(F.slice(F.array_sort(places), 1, most), lambda a, b: b["i"] - a["i"]), F.col("name"), lambda n, s: F.overlay(n, F.element_at(table, s["c"]), s["i"] + 1, F.lit(1)))
    return df.withColumn("generated", new).filter("generated != name")
