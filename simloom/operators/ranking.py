"""Ranks, first and last rows, top-k, frontiers and set operations in a stated order."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simloom.storage import materialize

#: Points of a frontier that are broadcast at once.
FRONTIER_BLOCK = 20_000


def rank_within(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key. Only a struct of the order and the row is aggregated, with partial sums."""
    return _edge(df, keys, order, F.min)


def last_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return _edge(df, keys, order, F.max)


def _edge(df: DataFrame, keys: list[str], order: list[Column], side) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[o.alias(f"_{k}") for k, o in enumerate(order)], *[F.col(c).alias(c) for c in rest])
    return df.groupBy(*keys).agg(side(row).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return rank_within(df, by, order, "rank").filter(F.col("rank") <= k)


def penalised_top(df: DataFrame, by: list[str], score: str, tie: list[Column], k: int, penalty: float = 0.01) -> DataFrame:
    """The k best of each group, each with its score less penalty times its 0-based rank."""
    top = top_per_group(df, by, [F.col(score).desc(), *tie], k)
    return top.withColumn("penalised", F.col(score) - penalty * (F.col("rank") - 1))


def _undominated(x: np.ndarray) -> np.ndarray:
    """Which rows no other row beats (all columns to be as large as possible). Rows are distinct.

    By falling sums, so that what beats a row comes before it; blocks meet the frontier found so far.
    """
    order = np.lexsort((*x.T, x.sum(axis=1)))[::-1]
    front = x[:0]
    kept = []
    for k in range(0, len(order), 256):
        some = order[k : k + 256]
        rows = x[some]
        others = np.concatenate([front, rows])
        beaten = ((others[:, None] >= rows[None]).all(axis=2) & (others[:, None] > rows[None]).any(axis=2)).any(axis=0)
        kept.append(some[~beaten])
        front = np.concatenate([front, rows[~beaten]])
    return np.concatenate(kept) if kept else order


def pareto_frontier(df: DataFrame, most: list[str], least: list[str]) -> DataFrame:
    """Rows that no other row beats: nowhere worse and somewhere better. Goals are numbers; rows with a null goal take no part.

    Of points that agree on all goals but the first only the best are kept. Each task sorts its points
    and sweeps them for its own frontier; of the survivors, few, each block meets all others.
    """
    goals = [F.col(c).cast("double") for c in most] + [-F.col(c).cast("double") for c in least]
    keys = [f"_g{k}" for k in range(len(goals))]
    rows = df.withColumns(dict(zip(keys, goals, strict=True))).dropna(subset=keys)
    slim = rows.groupBy(*keys[1:]).agg(F.max("_g0").alias("_g0")).select(*keys)

    def sweep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        front = None
        for b in batches:
            x = np.stack([np.asarray(c) for c in b.columns], axis=1)
            x = x if front is None else np.concatenate([front, x])
            front = x[_undominated(x)]
        if front is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in front.T], names=keys)

    local = materialize(slim.mapInArrow(sweep, ", ".join(f"{k} double" for k in keys)), "frontier")
    front = local
    parts = max(1, -(-local.count() // FRONTIER_BLOCK))
    for n in range(parts):
        some = F.broadcast(local.filter(F.pmod(F.xxhash64(*keys), F.lit(parts)) == n).toDF(*[f"_o{k}" for k in range(len(keys))]))
        every, better = F.lit(True), F.lit(False)
        for k, c in enumerate(keys):
            every, better = every & (F.col(f"_o{k}") >= F.col(c)), better | (F.col(f"_o{k}") > F.col(c))
        front = front.join(some, every & better, "left_anti")
    return rows.join(front.select(*keys), keys, "left_semi").select(*df.columns)


def bucketed_choice(df: DataFrame, gate: Column, buckets: list[str], order: list[Column], width: float = 0.01) -> DataFrame:
    """The first row by bucketed columns (halves to even), then order; of rows that pass the gate, or of all if none does."""
    marks = [F.bround(F.col(b) / width).cast("long") for b in buckets]
    return df.orderBy((~F.coalesce(gate, F.lit(False))).cast("int"), *marks, *order).limit(1)


def distinct_in_order(df: DataFrame, value: str, order: str) -> DataFrame:
    """Each value once, with the order of its first row."""
    return df.groupBy(value).agg(F.min(order).alias(order))


def disjoint_pools(df: DataFrame, key: str, pool: str, priority: list[str]) -> DataFrame:
    """Each key in the one pool that comes first in priority; keys of other pools go to the last one."""
    at = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(pool)), F.lit(0)).cast("int")
    at = F.when(at == 0, F.lit(len(priority))).otherwise(at)
    return df.groupBy(key).agg(F.min(at).alias("_p")).select(key, F.element_at(F.array(*[F.lit(p) for p in priority]), F.col("_p")).alias(pool))


def stack_by_name(*frames: DataFrame) -> DataFrame:
    """UNION ALL by name; columns that a frame lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def source_order(column: Column, order: list[str]) -> Column:
    """Place in a given order; others come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(o) for o in order]), column), F.lit(0).cast("long")), F.lit(len(order) + 1).cast("long"))
