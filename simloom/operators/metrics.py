"""Metrics of scored, labelled rows; every curve is exact, with ties taken together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simloom.functions.text import safe_divide
from simloom.storage import join_small, materialize


def running_totals(df: DataFrame, order: str, columns: list[str], descending: bool = False) -> DataFrame:
    """df with cum_<column>: sums of all rows up to this one by `order` (distinct values), without one task for all rows.

    Rows are range-partitioned; sums of partitions are few, and give each partition where it starts.
    """
    by = F.col(order).desc() if descending else F.col(order).asc()
    placed = materialize(df.repartitionByRange(by).withColumn("_p", F.spark_partition_id()), "ranges")
    ends = Window.orderBy(F.col("_p")).rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_p").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    starts = starts.select("_p", *[F.coalesce(F.sum(f"_{c}").over(ends), F.lit(0)).alias(f"_{c}") for c in columns])
    own = Window.partitionBy("_p").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    inner = placed.select("*", *[F.sum(c).over(own).alias(f"cum_{c}") for c in columns])
    joined = inner.join(F.broadcast(starts), "_p")
    return joined.select(*df.columns, *[(F.col(f"cum_{c}") + F.col(f"_{c}")).alias(f"cum_{c}") for c in columns])


def numbered(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """df with each row's number (from 1) within its group by `order` (distinct in a group), without one task for a group.

    Rows are range-partitioned by group and order; a partition's count of a group tells where the next one goes on.
    """
    by = [F.col(group), *[F.col(c) for c in order]]
    placed = materialize(df.repartitionByRange(*by).withColumn("_p", F.spark_partition_id()), "ranges")
    counts = placed.groupBy(group, "_p").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(group, "_p", before.alias("_before")).filter("_before IS NOT NULL")
    own = F.row_number().over(Window.partitionBy(group, "_p").orderBy(*order))
    joined = placed.withColumn(name, own).join(counts, [group, "_p"], "left")
    return joined.select(*df.columns, (F.col(name) + F.coalesce("_before", F.lit(0))).cast("long").alias(name))


def by_score(df: DataFrame) -> DataFrame:
    """score, pos and neg of each distinct score. df: score, label (0 or 1)."""
    return df.groupBy("score").agg(F.sum(F.col("label").cast("long")).alias("pos"), F.sum(1 - F.col("label").cast("long")).alias("neg"))


def roc_auc(df: DataFrame) -> DataFrame:
    """One row, roc_auc: the chance that a positive scores above a negative, ties half; null with one class."""
    c = running_totals(by_score(df), "score", ["pos", "neg"])
    wins = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") + F.col("neg") / 2.0))
    total = F.sum("pos") * F.sum("neg")
    return c.agg((wins / F.nullif(total, F.lit(0))).alias("roc_auc"))


def predictability(auc: Column) -> Column:
    return 0.5 + F.abs(auc - 0.5)


def _curve(df: DataFrame) -> DataFrame:
    """score, pos, neg, tp, fp (at or above the score) and all positives and negatives."""
    c = running_totals(by_score(df), "score", ["pos", "neg"], descending=True).withColumnsRenamed({"cum_pos": "tp", "cum_neg": "fp"})
    total = c.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    return c.join(F.broadcast(total))


def average_precision(df: DataFrame) -> DataFrame:
    """One row: the sum of recall steps times precision, at distinct scores; null without positives."""
    c = _curve(df)
    step = F.col("pos") / F.nullif(F.col("all_pos"), F.lit(0)) * (F.col("tp") / (F.col("tp") + F.col("fp")))
    return c.agg(F.sum(step).alias("average_precision"))


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return safe_divide(2 * tp, 2 * tp + fp + fn)


def best_f1(df: DataFrame) -> DataFrame:
    """One row, threshold and f1: the best F1 of score >= threshold; of equal ones the lowest threshold."""
    f = F.round(_f1(F.col("tp"), F.col("fp"), F.col("all_pos") - F.col("tp")), 12)
    c = _curve(df).withColumn("f1", f)
    best = F.max_by(F.struct("score", "f1"), F.struct("f1", (-F.col("score")).alias("_s")))
    return c.agg(best.alias("b")).select(F.col("b.score").alias("threshold"), F.col("b.f1").alias("f1"))


def fit_threshold(df: DataFrame) -> DataFrame:
    """One row, threshold, balanced_accuracy and f1, over midpoints of scores and just beyond the ends.

    The best balanced accuracy wins (compared to nine digits), then F1, then the lowest threshold.
    """
    c = _curve(df)
    bounds = c.agg(F.min("score").alias("low"), F.max("score").alias("high"))
    # the next lower score of each has the next number
    ranked = running_totals(c.select("score", "tp", "fp", "all_pos", "all_neg", F.lit(1).alias("one")), "score", ["one"], descending=True)
    nxt = ranked.select((F.col("cum_one") - 1).alias("cum_one"), F.col("score").alias("lower"))
    mid = ranked.join(nxt, "cum_one", "left").join(F.broadcast(bounds))
    threshold = F.coalesce((F.col("score") + F.col("lower")) / 2, F.col("low") - 1e-9)
    cands = mid.select(threshold.alias("threshold"), "tp", "fp", "all_pos", "all_neg")
    top = mid.filter("score = high").select((F.col("high") + 1e-9).alias("threshold"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), "all_pos", "all_neg")
    both = cands.unionByName(top)
    ba = (safe_divide(F.col("tp"), F.col("all_pos")) + safe_divide(F.col("all_neg") - F.col("fp"), F.col("all_neg"))) / 2
    both = both.withColumn("balanced_accuracy", F.round(ba, 9)).withColumn("f1", F.round(_f1(F.col("tp"), F.col("fp"), F.col("all_pos") - F.col("tp")), 9))
    best = F.max_by(F.struct("threshold", "balanced_accuracy", "f1"), F.struct("balanced_accuracy", "f1", (-F.col("threshold")).alias("_t")))
    return both.agg(best.alias("b")).select("b.threshold", "b.balanced_accuracy", "b.f1")


def confusion(df: DataFrame, threshold: Column | float, by: list[str] | None = None) -> DataFrame:
    """Counts and rates at score >= threshold, for each group in by. Rates of nothing are 0."""
    t = F.lit(threshold) if isinstance(threshold, float | int) else threshold
    up, is_pos = F.col("score") >= t, F.col("label") == 1
    counts = (df.groupBy(*by) if by else df.groupBy()).agg(
        F.count_if(up & is_pos).alias("tp"), F.count_if(up & ~is_pos).alias("fp"), F.count_if(~up & ~is_pos).alias("tn"), F.count_if(~up & is_pos).alias("fn"), F.avg(F.when(is_pos, F.col("score"))).alias("positive_mean"), F.avg(F.when(~is_pos, F.col("score"))).alias("negative_mean")
    )
    return with_rates(counts)


def with_rates(counts: DataFrame) -> DataFrame:
    """tp, fp, tn, fn with accuracy, balanced_accuracy, precision, recall, specificity, f1 and mcc."""
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    recall, specificity = safe_divide(tp, tp + fn), safe_divide(tn, tn + fp)
    mcc = safe_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    rates = {"accuracy": safe_divide(tp + tn, tp + fp + tn + fn), "balanced_accuracy": (recall + specificity) / 2, "precision": safe_divide(tp, tp + fp), "recall": recall, "specificity": specificity, "f1": _f1(tp, fp, fn), "mcc": mcc}
    return counts.withColumns(rates)


def threshold_on_before(before: DataFrame, after: DataFrame) -> DataFrame:
    """Fit the threshold on `before`, and judge both: stage and the columns of confusion."""
    t = materialize(fit_threshold(before).select(F.col("threshold").alias("_t")), "threshold")
    cols = lambda df, stage: df.select("score", "label", F.lit(stage).alias("stage"))
    rows = cols(before, "before").unionByName(cols(after, "after")).join(F.broadcast(t))
    return confusion(rows, F.col("_t"), ["stage"])


def stats(values: Column, prefix: str = "") -> list[Column]:
    """count, mean, q25, median, min and population deviation, exact."""
    q = lambda p: F.percentile(values, F.lit(p))
    return [F.count(values).alias(f"{prefix}count"), F.avg(values).alias(f"{prefix}mean"), q(0.25).alias(f"{prefix}q25"), q(0.5).alias(f"{prefix}median"), F.min(values).alias(f"{prefix}min"), F.stddev_pop(values).alias(f"{prefix}std")]


#: Rows of a group whose quantiles one hash table may find, rows of a cell that are sorted at once, and cuts of a round.
HELD, SORTED, CUTS = 200_000, 4096, 64


def exact_quantiles(df: DataFrame, by: list[str], value: Column, shares: list[float]) -> DataFrame:
    """by and q: the exact quantiles of each group's values in the order of shares, interpolated between neighbours; nulls don't count.

    Groups of up to HELD values go through a hash table each. For larger ones ranks are selected: sketches of a fixed size cut
    a group in cells, cells are counted, and those that hold a wanted rank are cut again, until they have SORTED
    values or a single one. So no task holds a group, whatever its size and its distribution.
    """
    part = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")
    rows = materialize(df.select(part.alias("part"), *by, value.cast("double").alias("v")).filter("v IS NOT NULL"), "values")
    sizes = materialize(rows.groupBy("part").agg(*[F.first(c).alias(c) for c in by], F.count(F.lit(1)).alias("n")), "sizes")
    large = materialize(sizes.filter(F.col("n") > HELD).select("part", "n"), "large")
    rows = rows.select("part", "v")
    told = join_small(rows, large.select("part"), "part", "left_anti").groupBy("part").agg(F.percentile("v", F.array(*[F.lit(float(p)) for p in shares])).alias("q"))
    if large.limit(1).count():
        told = told.unionByName(_selected(join_small(rows, large.select("part"), "part", "left_semi"), large, shares))
    return sizes.join(told, "part").select(*by, "q")


def _selected(rows: DataFrame, large: DataFrame, shares: list[float]) -> DataFrame:
    """part, q for parts that are too large to sort. rows: part, v; large: part, n."""
    place = [F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("n") - 1)).alias("at")) for i, p in enumerate(shares)]
    want = materialize(large.select("part", F.explode(F.array(*place)).alias("w")).select(F.col("part").alias("root"), "w.i", F.floor("w.at").alias("low"), F.ceil("w.at").alias("high"), (F.col("w.at") - F.floor("w.at")).alias("share")), "ranks")
    todo = want.select("root", F.explode(F.array_distinct(F.array("low", "high"))).alias("rank")).distinct().select("root", "rank", F.col("root").alias("part"), F.col("rank").alias("k"))
    found, grid = None, F.array(*[F.lit(i / CUTS) for i in range(1, CUTS)])
    while True:
        cuts = materialize(rows.groupBy("part").agg(F.percentile_approx("v", grid, F.lit(2000)).alias("cuts")), "cuts")
        below, upto = F.size(F.filter("cuts", lambda c: c < F.col("v"))), F.size(F.filter("cuts", lambda c: c <= F.col("v")))
        placed = materialize(join_small(rows, cuts, "part").select("part", "v", (below + upto).alias("cell")), "cells")  # values that are cuts have cells of their own
        over = Window.partitionBy("part").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        counts = placed.groupBy("part", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most")).withColumn("before", F.coalesce(F.sum("n").over(over), F.lit(0)))
        at = materialize(todo.join(counts, "part").filter("k >= before AND k < before + n").withColumn("k", F.col("k") - F.col("before")), "ranks")
        one = at.filter("least = most").select("root", "rank", F.col("least").alias("v"))
        sort = at.filter(f"least < most AND n <= {SORTED}")
        lists = join_small(placed, materialize(sort.select("part", "cell").distinct(), "sorted"), ["part", "cell"], "left_semi").groupBy("part", "cell").agg(F.array_sort(F.collect_list("v")).alias("vs"))
        few = sort.join(lists, ["part", "cell"]).select("root", "rank", F.get("vs", F.col("k").cast("int")).alias("v"))
        told = materialize(one.unionByName(few), "found")
        found = told if found is None else found.unionByName(told)
        todo = at.filter(f"least < most AND n > {SORTED}").select("root", "rank", F.concat_ws("/", "part", "cell").alias("part"), "k")
        if not todo.limit(1).count():
            break
        next_cells = materialize(at.filter(f"least < most AND n > {SORTED}").select("part", "cell").distinct(), "open")
        rows = materialize(join_small(placed, next_cells, ["part", "cell"], "left_semi").select(F.concat_ws("/", "part", "cell").alias("part"), "v"), "values")
    low, high = (found.select("root", F.col("rank").alias(c), F.col("v").alias(f"v_{c}")) for c in ("low", "high"))
    values = want.join(low, ["root", "low"]).join(high, ["root", "high"]).withColumn("x", F.col("v_low") + (F.col("v_high") - F.col("v_low")) * F.col("share"))
    return values.groupBy(F.col("root").alias("part")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("q"))


def with_quantiles(df: DataFrame, by: list[str], aggregates: list[Column], quantiles: dict[str, tuple[Column, float]]) -> DataFrame:
    """aggregates and exact quantiles (name: value, share) of each group: in one pass if no group has more than HELD rows."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    if not sizes.filter(F.col("_n") > HELD).limit(1).count():
        return df.groupBy(*by).agg(*aggregates, *[F.percentile(v, F.lit(p)).alias(n) for n, (v, p) in quantiles.items()])
    out = df.groupBy(*by).agg(*aggregates)
    values: dict[str, list[str]] = {}
    for name, (v, _) in quantiles.items():
        values.setdefault(str(v), []).append(name)
    for names in values.values():
        q = exact_quantiles(df, by, quantiles[names[0]][0], [quantiles[n][1] for n in names])
        q = q.select(*[F.col(c).alias(f"_{c}") for c in by], *[F.col("q")[i].alias(n) for i, n in enumerate(names)])
        on = F.lit(True)
        for c in by:
            on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
        out = out.join(q, on, "left").drop(*[f"_{c}" for c in by])
    return out


def stats_by(df: DataFrame, value: str, by: str) -> DataFrame:
    """stats overall and for each value of `by`; the overall row has overall 1 and null for by."""
    v = F.col(value)
    aggregates = [F.count(v).alias("count"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.stddev_pop(v).alias("std")]
    if df.limit(HELD + 1).count() <= HELD:
        return df.groupingSets([[F.col(by)], []], F.col(by)).agg(F.grouping(by).cast("int").alias("overall"), *stats(v))
    quantiles = {"q25": (v, 0.25), "median": (v, 0.5)}
    own = with_quantiles(df, [by], aggregates, quantiles).withColumn("overall", F.lit(0))
    whole = with_quantiles(df, [], aggregates, quantiles).withColumn("overall", F.lit(1)).withColumn(by, F.lit(None).cast(df.schema[by].dataType))
    return own.unionByName(whole).select(by, "overall", "count", "mean", "q25", "median", "min", "std")


def distance_summary(df: DataFrame, distance: str, length: str, by: list[str]) -> DataFrame:
    """Mean and quartiles of distances, absolute and relative to the length."""
    rel = F.col(distance) / F.greatest(F.col(length), F.lit(1))
    values, shares = {"abs": F.col(distance), "rel": rel}, {"q25": 0.25, "median": 0.5, "q75": 0.75}
    means = [F.avg(c).alias(f"{name}_mean") for name, c in values.items()]
    out = with_quantiles(df, by, [F.count(F.lit(1)).alias("n"), *means], {f"{name}_{q}": (c, p) for name, c in values.items() for q, p in shares.items()})
    return out.select(*by, "n", *[f"{name}_{x}" for name in values for x in ("mean", *shares)])


def rule_quantiles(df: DataFrame, by: list[str], score: str, least: int) -> DataFrame:
    """Quantiles, mean and support of each rule's scores."""
    q = {"min": 0.0, "q25": 0.25, "median": 0.5, "max": 1.0}
    out = with_quantiles(df, by, [F.avg(score).alias("score_mean"), F.count(score).alias("num_scored_examples")], {f"score_{k}": (F.col(score), p) for k, p in q.items()})
    return out.select(*by, *[f"score_{k}" for k in q], "score_mean", "num_scored_examples").withColumn("meets_min_support", F.col("num_scored_examples") >= least)


def rule_support(rules: DataFrame, examples: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Rules with how many examples they have and the first one."""
    found = examples.groupBy(by).agg(F.count(F.lit(1)).alias("support"), F.min_by(value, order).alias("first_example"))
    return rules.join(found, by, "left").withColumn("support", F.coalesce("support", F.lit(0)))


def most_common(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value; of equally frequent ones the least."""
    n = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(*by).agg(F.max(F.col("_n")).alias("times"), F.min_by(value, F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v"))).alias(value))


def axis_marginals(df: DataFrame, axes: list[str], value: str) -> DataFrame:
    """n, mean, population deviation, least and greatest value for each value of each axis."""
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("level")) for a in axes]))
    long = df.select(pairs.alias("p"), F.col(value).alias("_v")).select("p.*", "_v")
    return long.groupBy("axis", "level").agg(F.count("_v").alias("n"), F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std"), F.min("_v").alias("least"), F.max("_v").alias("most"))


def overlap_report(sets_a: DataFrame, sets_b: DataFrame, column: str) -> DataFrame:
    """Sizes of two sets of values, of what they share, and the shares of each; and whether they are equal."""
    a, b = sets_a.select(column).distinct(), sets_b.select(column).distinct()
    # a full join on keys, counted by side: neither set is held anywhere
    both = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), column, "full")
    n = both.agg(F.count("_a").alias("left_size"), F.count("_b").alias("right_size"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("shared"))
    return n.select("*", safe_divide(F.col("shared"), F.col("left_size")).alias("left_share"), safe_divide(F.col("shared"), F.col("right_size")).alias("right_share"), ((F.col("shared") == F.col("left_size")) & (F.col("shared") == F.col("right_size"))).alias("equal_sets"))


def ordered_digest(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """One row, digest: equal for equal rows in equal order. Hashes of row hashes by ranges of the order, then of these.

    order: non-negative row numbers. Ranges have 1,024 rows, so that no task holds them all.
    """
    row = F.sha2(F.concat_ws("\x00", *[F.coalesce(F.col(c).cast("string"), F.lit("\x01")) for c in columns]).cast("binary"), 256)
    level = df.select(F.col(order).cast("long").alias("_o"), row.alias("_h"))
    while True:
        level = level.groupBy(F.floor(F.col("_o") / 1024).alias("_o")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_h"))), lambda s: s["_h"]), "").cast("binary"), 256).alias("_h"))
        level = materialize(level, "digest")
        if level.limit(2).count() <= 1:
            return level.select(F.col("_h").alias("digest"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row, duplicates: rows beyond the first of each key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))


def family_counts(operations: Column, families: list[str]) -> list[Column]:
    """How many operations of each family, and of all, known or not."""
    n = lambda f: F.size(F.filter(operations, lambda o: o["family"] == f))
    return [*[n(f).alias(f"{f}_count") for f in families], F.size(operations).alias("total_count")]


def best_epoch(log: DataFrame, by: list[str]) -> DataFrame:
    """The earliest epoch of the best val_auc."""
    return log.groupBy(*by).agg(F.min_by("epoch", F.struct((-F.col("val_auc")).alias("a"), F.col("epoch").alias("e"))).alias("best_epoch"), F.max("val_auc").alias("best_val_auc"))
