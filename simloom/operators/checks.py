"""Contracts and invariants: one pass of counts, then a verdict on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.functions.text import clean_anywhere, has_dot_com, safe_divide


def pair_violations(pairs: DataFrame) -> DataFrame:
    """One row of counts: labels outside {0, 1}, empty names, names with .com. pairs: fraudulent_name, real_name, label."""
    return pairs.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~F.coalesce(F.col("label").isin(0.0, 1.0), F.lit(False))).alias("bad_labels"),
        F.count_if((F.coalesce("fraudulent_name", F.lit("")) == "") | (F.coalesce("real_name", F.lit("")) == "")).alias("empty_names"),
        F.count_if(has_dot_com(F.col("fraudulent_name")) | has_dot_com(F.col("real_name"))).alias("dot_com"),
    )


def dataset_violations(generated: DataFrame) -> DataFrame:
    """One row of counts that must be 0 for generated pairs: fraudulent_name, real_name, label, operations (array, null for negatives)."""
    pos = F.col("label") == 1
    key = F.lower("fraudulent_name")
    counts = generated.agg(
        F.count_if(pos & (key == F.lower("real_name"))).alias("unchanged"),
        F.count_if(pos & (F.coalesce(F.size("operations"), F.lit(0)) < 1)).alias("without_operation"),
        F.count_if(has_dot_com(F.col("fraudulent_name"))).alias("dot_com"),
        F.count_if((F.coalesce("fraudulent_name", F.lit("")) == "") | (F.coalesce("real_name", F.lit("")) == "")).alias("empty_names"),
        F.count_if(~F.coalesce(F.col("label").isin(0.0, 1.0), F.lit(False))).alias("bad_labels"),
        F.count_if((F.col("label") == 0) & (key == F.lower("real_name"))).alias("equal_negatives"),
    )
    twice = generated.filter(pos).groupBy(key.alias("k")).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("repeated_keys"))
    return counts.join(F.broadcast(twice))


def compared(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """One row: counts per key that changed, keys lost and keys new (all 0 if the two agree)."""
    n = lambda df, c: df.groupBy(key).agg(F.count(F.lit(1)).alias(c))
    both = n(before, "_a").join(n(after, "_b"), key, "full")
    return both.agg(F.count_if(F.col("_a") != F.col("_b")).alias("changed_counts"), F.count_if(F.col("_b").isNull()).alias("lost_keys"), F.count_if(F.col("_a").isNull()).alias("new_keys"))


def disjoint(df: DataFrame, key: str, split: str) -> DataFrame:
    """One row, shared_keys: keys in more than one split."""
    return df.groupBy(key).agg(F.count_distinct(split).alias("_n")).agg(F.count_if(F.col("_n") > 1).alias("shared_keys"))


def require_none(violations: DataFrame, ignore: tuple[str, ...] = ("n_rows",)) -> dict[str, int]:
    """The counts; raises if one that isn't ignored isn't 0."""
    row = violations.first().asDict()
    bad = {k: v for k, v in row.items() if k not in ignore and v}
    if bad:
        raise ValueError(f"violated: {bad}")
    return row


def quality_gates(new: dict[str, float], old: dict[str, float], most: float = 0.95, slack: float = 0.02, warn: bool = False) -> list[str]:
    """What is above `most`, or above its old value by more than slack; raises unless warn."""
    found = [f"{k} is {v:.4f}" for k, v in new.items() if v > most or (k in old and v > old[k] + slack)]
    if found and not warn:
        raise ValueError("; ".join(found))
    return found


def cleaned_pairs(df: DataFrame, cleaner=clean_anywhere, drop_empty: bool = False, as_negatives: bool = False) -> DataFrame:
    """Pairs with cleaned names and a double label. drop_empty leaves out empty names without complaint;
    as_negatives sets the label 0 and leaves out pairs that are equal in lower case."""
    out = df.select(cleaner(F.col("fraudulent_name")).alias("fraudulent_name"), cleaner(F.col("real_name")).alias("real_name"), F.col("label").cast("double").alias("label"))
    if drop_empty:
        out = out.filter("fraudulent_name != '' AND real_name != ''")
    if as_negatives:
        out = out.withColumn("label", F.lit(0.0)).filter(F.lower("fraudulent_name") != F.lower("real_name"))
    return out


def modification_rates(df: DataFrame, counts: list[str]) -> DataFrame:
    """The share of rows with at least one operation of each family."""
    return df.agg(*[F.avg((F.col(c) > 0).cast("int")).alias(f"{c}_rate") for c in counts])


def label_counts(df: DataFrame) -> DataFrame:
    n, p = F.count(F.lit(1)), F.count_if(F.col("label") == 1)
    return df.agg(n.alias("n_rows"), p.alias("positive"), F.count_if(F.col("label") == 0).alias("negative"), safe_divide(p, n).alias("positive_share"))
