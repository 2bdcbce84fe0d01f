"""Exact top-k search by inner product with MaxScore over sharded postings."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simloom.llm.arrow import batch
from simloom.storage import materialize, scratch

#: Queries that are broadcast and answered at once.
BLOCK_QUERIES = 2_000
#: Vectors of a shard's postings that are in memory at once.
SHARD_ROWS = 16_384
#: Terms that are probed between two tests of whether a candidate is still competitive.
PROBE = 8
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
#: Above this, doubles don't hold every sum exactly.
_EXACT = 2**53


def impacts(embedding: Column, scale: int) -> Column:
    """floor(scale * x) of each component as long; null if the vector or a component is null or not finite."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(embedding.isNotNull() & ~F.coalesce(bad, F.lit(False)), F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of equal length; shorter vectors end in zeros, which add nothing to a score."""
    sizes = np.asarray(column.value_lengths())
    values = np.asarray(column.flatten())
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def _fit(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x


def search_shard(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, floor: dict[int, int]) -> list[tuple[np.ndarray, ...]]:
    """The k best of this shard for each query: query id, vector ids, scores.

    A term is a dimension; its posting list holds every vector's impact. With lo and hi the least
    and greatest contribution of a term, terms go by hi - lo. The first ones, until the rest can't
    lift a vector over the threshold, are essential: their postings are traversed for all vectors.
    The others are probed a few at a time for those vectors that are still competitive. floor keeps
    each query's threshold from one shard of a task to the next.
    """
    width = max(x.shape[1], queries.shape[1])
    x, queries = _fit(x, width), _fit(queries, width)
    largest = float(np.abs(x).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(width, 1)
    kind = np.float64 if largest < _EXACT else np.int64
    postings = np.ascontiguousarray(x.T.astype(kind))
    low, high = (postings.min(axis=1), postings.max(axis=1)) if width else (np.zeros(0, kind),) * 2
    found = []
    for q_id, q in zip(query_ids.tolist(), queries.astype(kind), strict=True):
        a, b = q * low, q * high
        top, bottom = np.maximum(a, b), np.minimum(a, b)
        order = np.argsort(bottom - top, kind="stable")
        rest = np.concatenate([np.cumsum(top[order][::-1])[::-1], np.zeros(1, kind)])  # the most that terms from here on add
        own = ids == q_id
        theta = floor.get(q_id)
        # with no threshold yet, the vectors that are best on the strongest terms give one
        if theta is None and len(ids) - own.sum() > k:
            some = order[:PROBE]
            part = np.where(own, np.iinfo(np.int64).min // 2 if kind is np.int64 else -np.inf, q[some] @ postings[some])
            best = np.argpartition(part, len(part) - k)[len(part) - k :]
            theta = int((q @ postings[:, best]).min())
        essential = width
        if theta is not None and width:
            # the strongest a vector can be on the rest alone, its essential terms being at their least
            alone = np.cumsum(bottom[order]) + rest[1:]
            essential = int(np.argmax(alone < theta)) + 1 if (alone < theta).any() else width
        head = order[:essential]
        score = q[head] @ postings[head] if width else np.zeros(len(ids), kind)
        live = np.flatnonzero(~own & (score + rest[essential] >= theta)) if theta is not None else np.flatnonzero(~own)
        score, at = score[live], essential
        while at < width and len(live):
            more = order[at : at + PROBE]
            score = score + q[more] @ postings[np.ix_(more, live)]
            at += len(more)
            if theta is not None:
                still = score + rest[at] >= theta
                live, score = live[still], score[still]
        if len(live) > k:
            kth = np.partition(score, len(score) - k)[len(score) - k]
            keep = score >= kth
            live, score = live[keep], score[keep]
            best = np.lexsort((ids[live], -score))[:k]
            live, score = live[best], score[best]
            floor[q_id] = max(int(score[-1]), floor.get(q_id, int(score[-1])))
        found.append((np.full(len(live), q_id), ids[live], score.astype(np.int64)))
    return found


def top_k(vectors: DataFrame, queries: Column, k: int = 10, scale: int = 1024, block: int = BLOCK_QUERIES) -> DataFrame:
    """The k vectors of the highest integer inner product for each row that `queries` selects.

    vectors: vec_id, embedding; other columns are ignored. Components become floor(scale * x).
    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id. vec_id names a
    row: candidates with the query's own vec_id are the query itself. Of rows that repeat a query's
    vec_id the smallest vector asks. Rows without vec_id, and vectors that are null or hold null or
    non-finite components, take no part; shorter vectors count as ending in zeros. An empty table
    gives no rows; fewer than k candidates give as many rows.

    Scale: queries go in blocks of a bounded size, one after the other: a block is broadcast, meets
    all vectors where they lie, and is let go when its answers are stored. A task gives k rows for
    each query, and a window by query merges the shards.
    """
    with scratch(vectors.sparkSession) as whole:
        return _answers(vectors, queries, k, scale, block, whole)


def _answers(vectors: DataFrame, queries: Column, k: int, scale: int, block: int, whole: scratch) -> DataFrame:
    spark = vectors.sparkSession
    data = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), impacts(F.col("embedding"), scale).alias("x"), queries.alias("_q")).filter("vec_id IS NOT NULL AND x IS NOT NULL")
    asked = materialize(data.filter("_q").groupBy("vec_id").agg(F.min("x").alias("x")), "top-k-asked")
    blocks = max(1, -(-asked.count() // block))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    answers = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for n in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == n)
        held = part.orderBy("vec_id").toArrow()
        if not held.num_rows:
            continue
        got = held.column("x").combine_chunks()
        shared = spark.sparkContext.broadcast((np.asarray(held.column("vec_id")), _matrix(got)))

        def search(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            query_ids, q = shared.value
            floor: dict[int, int] = {}
            ids, xs, rows = [], [], 0

            def answered() -> Iterator[pa.RecordBatch]:
                width = max(m.shape[1] for m in xs)
                for some in range(0, len(query_ids), 256):
                    s = slice(some, some + 256)
                    found = search_shard(np.concatenate(ids), np.concatenate([_fit(m, width) for m in xs]), query_ids[s], q[s], k, floor)
                    yield batch(_FOUND, *[np.concatenate(c) for c in zip(*found, strict=True)])

            for b in batches:
                if b.num_rows:
                    ids.append(np.asarray(b.column(0)))
                    xs.append(_matrix(b.column(1)))
                    rows += b.num_rows
                if rows >= SHARD_ROWS:
                    yield from answered()
                    ids, xs, rows = [], [], 0
            if rows:
                yield from answered()

        found = data.select("vec_id", "x").mapInArrow(search, "query_id long, vec_id long, score long")
        merged = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        answers = answers.unionByName(whole.keep(merged, "top-k"))
        shared.destroy()
    return answers
