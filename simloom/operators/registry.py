"""Keyed tables over time: upserts, memos, resumed work, replacement and review."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.operators.metrics import with_quantiles
from simloom.operators.ranking import last_per_key
from simloom.storage import materialize, recover, swap_in


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of all rows of a key the last by order; rows of new come after rows of old with the same order."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return last_per_key(both, keys, [F.col(order), F.col("_new")]).drop("_new")


def write_upserted(spark: SparkSession, path: str, new: DataFrame, keys: list[str], order: str) -> None:
    """Upsert into a Parquet table: the result is written beside it, then takes its place by renames (see swap_in)."""
    recover(spark, path)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    target, staged = fs_path(path), path.rstrip("/") + ".next"
    there = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    result = upsert(spark.read.parquet(path), new, keys, order) if there else last_per_key(new, keys, [F.col(order)])
    result.write.mode("overwrite").parquet(staged)
    swap_in(spark, staged, path)


def scored_with_memo(requests: DataFrame, memo: DataFrame, keys: list[str], scorer: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(requests with score, the memo with what was missing, counts). Only distinct missing keys are scored.

    scorer adds score to a DataFrame of keys. Requests keep their columns, so an order column gives their order.
    """
    asked = requests.select(*keys).distinct()
    missing = materialize(asked.join(memo, keys, "left_anti"), "memo-missing")
    fresh = materialize(scorer(missing).select(*keys, "score"), "memo-scores")
    grown = memo.select(*keys, "score").unionByName(fresh)
    return requests.join(grown, keys, "left"), grown, {"requested": asked.count(), "missing": missing.count()}


def unfinished(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def replaced(rows: DataFrame, replacements: DataFrame, keep_unreplaced: Column) -> DataFrame:
    """rows (row_idx, fraudulent_name, ...) with new names in place; rows without one go, unless keep_unreplaced."""
    new = replacements.select("row_idx", F.col("generated").alias("_new"))
    out = rows.join(new, "row_idx", "left").filter(F.col("_new").isNotNull() | keep_unreplaced)
    return out.withColumn("fraudulent_name", F.coalesce("_new", "fraudulent_name")).drop("_new")


def above_threshold(rows: DataFrame, least: float, quantile: float) -> tuple[DataFrame, DataFrame]:
    """(kept, report): negatives, and positives whose score is above the greater of `least` and the positives' quantile."""
    cut = with_quantiles(rows.filter("label = 1"), [], [F.count(F.lit(1)).alias("n")], {"q": (F.col("score"), quantile)})
    cut = cut.select(F.greatest(F.lit(float(least)), F.coalesce("q", F.lit(float(least)))).alias("threshold"))
    marked = rows.join(F.broadcast(cut)).withColumn("kept", (F.col("label") == 0) | F.coalesce(F.col("score") > F.col("threshold"), F.lit(False)))
    report = marked.groupBy("threshold").agg(F.count_if(F.col("label") == 1).alias("positives"), F.count_if((F.col("label") == 1) & F.col("kept")).alias("kept_positives"), F.count_if(F.col("label") == 0).alias("negatives"))
    return marked.filter("kept").drop("kept", "threshold"), report


def reviewed(rules: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """rules with review_state and reviewed_at from the last decision (keep, discard, skip) of each."""
    last = last_per_key(decisions.select(*keys, "decision", "at"), keys, [F.col("at"), F.col("decision")])
    return rules.join(last, keys, "left").withColumn("review_state", F.coalesce("decision", F.lit("open"))).withColumn("reviewed_at", F.col("at")).drop("decision", "at")


def auto_labelled(rules: DataFrame, source: str, thresholds: DataFrame) -> DataFrame:
    """Open rules get keep or discard by their source's threshold (source, keep_threshold); decided ones stay."""
    joined = rules.join(thresholds, source, "left")
    state = F.when(F.col("review_state") != "open", F.col("review_state")).when(F.col("keep_threshold").isNull(), "open").when(F.col("score") >= F.col("keep_threshold"), "keep").otherwise("discard")
    return joined.withColumn("review_state", state)


def screened(outputs: DataFrame, by: list[str], clean_rate: float, attack_rate: float) -> DataFrame:
    """Candidates that every model passes: columns clean, attack (rates) and label of each model."""
    n = outputs.groupBy(*by).agg(F.every(F.col("clean") >= clean_rate).alias("all_clean"), F.some(F.col("attack") >= attack_rate).alias("any_attack"), F.count_distinct("label").alias("labels"), F.min("label").alias("label"))
    return n.withColumn("accepted", F.col("all_clean") & F.col("any_attack") & (F.col("labels") == 1))


def grid_search(trials: list[dict], run: Callable[[dict], dict], penalty: dict) -> list[dict]:
    """Each trial's parameters (param_) and results; a trial that raises gets the penalty and its error."""
    rows = []
    for n, params in enumerate(trials):
        try:
            told = run(params) | {"error": ""}
        except Exception as e:  # a trial may fail in any way; the search goes on
            told = penalty | {"error": f"{type(e).__name__}: {e}"}
        rows.append({"trial_number": n} | {f"param_{k}": v for k, v in params.items()} | told)
    return rows
