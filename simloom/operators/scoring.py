"""Pluggable batch scorers, score tables and reports over scored pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simloom.functions.text import canonical_ocr, number_or

Scorer = Callable[[list[tuple[str, str]]], list[float]]


def batch_scorer(load: Callable[[], Scorer], batch_size: int = 256) -> Callable[[Column, Column], Column]:
    """A column function of (real name, candidate). `load` runs once in each worker, and gives what scores lists of pairs."""

    def scored(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        score = load()
        for a, b in parts:
            pairs = list(zip(a.fillna(""), b.fillna(""), strict=True))
            out: list[float] = []
            for k in range(0, len(pairs), batch_size):
                out += score(pairs[k : k + batch_size])
            yield pd.Series(out, dtype=float)

    scored.__annotations__ = {"parts": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(scored, T.DoubleType())


def text_scorer() -> Scorer:
    """A deterministic stand-in for a legibility model: the share of places with equal characters, in -1 to 4."""
    return lambda pairs: [5 * sum(x == y for x, y in zip(a, b, strict=False)) / max(len(a), len(b), 1) - 1 for a, b in pairs]


def score_distinct(pairs: DataFrame, keys: list[str], score: Column) -> DataFrame:
    """pairs with score, worked out once for each distinct pair."""
    return pairs.join(pairs.select(*keys).distinct().withColumn("score", score), keys)


def with_outputs(texts: DataFrame, models: dict[str, DataFrame], key: str) -> DataFrame:
    """texts with a column for each model (key, output), found by text."""
    out = texts
    for name, df in models.items():
        out = out.join(df.select(key, F.col("output").alias(name)), key, "left")
    return out


def cascade(rows: DataFrame, cheap: Column, passes: Callable[[Column], Column], costly: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """costly on those rows alone whose cheap output passes; the filter stands before it in the plan."""
    return costly(rows.withColumn("cheap_output", cheap).filter(passes(F.col("cheap_output"))))


def aligned(left: DataFrame, right: DataFrame, order: str = "row_idx") -> DataFrame:
    """Rows side by side by their number, which both carry."""
    return left.join(right, order)


def canonical_equal(a: Column, b: Column) -> Column:
    return (canonical_ocr(a) == canonical_ocr(b)).cast("int")


def symmetric_confusions(rules: DataFrame) -> DataFrame:
    """left, right, similarity in both directions: single characters in lower case, within 0 to 1, the greatest of each pair.

    rules: source, replacement, score.
    """
    s = F.least(F.lit(1.0), F.greatest(F.lit(0.0), number_or(F.col("score"), F.lit(0.0))))
    ok = rules.filter((F.length("source") == 1) & (F.length("replacement") == 1)).select(F.lower("source").alias("a"), F.lower("replacement").alias("b"), s.alias("s")).filter("a != b")
    both = F.explode(F.array(F.struct(F.col("a").alias("left"), F.col("b").alias("right")), F.struct(F.col("b").alias("left"), F.col("a").alias("right"))))
    return ok.select(both.alias("p"), "s").select("p.*", "s").groupBy("left", "right").agg(F.max("s").alias("similarity"))


def before_and_after(scores: DataFrame, by: list[str]) -> DataFrame:
    """before, after and delta of each pair. scores: by, stage (before or after), score."""
    of = lambda stage: F.max(F.when(F.col("stage") == stage, F.col("score")))
    return scores.groupBy(*by).agg(of("before").alias("before"), of("after").alias("after")).withColumn("delta", F.col("after") - F.col("before"))


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def mode_counts(df: DataFrame, column: str, prefixes: list[str]) -> DataFrame:
    """Rows whose column begins with each prefix, in one row."""
    return df.agg(*[F.count_if(F.col(column).startswith(p)).alias(f"n_{p}") for p in prefixes])


def reasons(df: DataFrame, reason: str = "reason") -> DataFrame:
    """Attempts and skips by reason; kept rows have none."""
    return df.groupBy(F.coalesce(reason, F.lit("kept")).alias(reason)).agg(F.count(F.lit(1)).alias("n"))
