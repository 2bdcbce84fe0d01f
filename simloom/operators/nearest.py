"""Nearest rows by a partition of space: every row in a leaf, and only leaves within the best distance so far are met.

A space gives each row coordinates and a gap: a lower bound of the distance from a query to all that lies in a box. Cuts come from
a bounded sample and are few; rows, boxes of leaves and pairs of blocks are Spark's. Queries meet their own leaf first,
then the nearest other leaves, then all whose gap is within the k-th distance found, so that the bound shrinks on the way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simloom.functions import batch_edit
from simloom.storage import materialize

#: Rows that cuts are drawn from, rows of a leaf, of a block of points and of a block of queries, and blocks that have cuts of their own.
SAMPLE_ROWS, LEAF_ROWS, POINTS, QUERIES, BLOCKS = 20_000, 256, 512, 128, 1024
#: Leaves that a query meets before its bound is taken again, and again.
NEAR_LEAVES = (2, 8)


class FeatureSpace:
    """Coordinates are features, the last one a distance: Euclidean gap of the features plus weight times that of the distances."""

    #: Distances this much beyond the k-th still count, as they may be equal to it once they are rounded to 9 digits.
    slack = 2e-9

    def __init__(self, weight: float):
        self.weight = weight

    def gap(self, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        out = np.zeros((len(q), len(low)))
        for k in range(q.shape[1] - 1):
            d = np.maximum(np.maximum(low[None, :, k] - q[:, k, None], q[:, k, None] - high[None, :, k]), 0)
            out += d * d
        d = np.maximum(np.maximum(low[None, :, -1] - q[:, -1, None], q[:, -1, None] - high[None, :, -1]), 0)
        return np.sqrt(out) + self.weight * d

    def exact(self, q: np.ndarray, p: np.ndarray, q_text: list, p_text: list) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """A function of pairs of places."""

        def told(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            d = q[i] - p[j]
            return np.sqrt((d[:, :-1] ** 2).sum(1)) + self.weight * np.abs(d[:, -1])

        return told


class EditSpace:
    """Names under edit distance: coordinates are the distances to pivots, the length, and counts of letters by group.

    An edit changes the distance to a pivot, and the length, by one at most, and takes one letter from a group and
    gives one to another at most; what texts differ by in these is a lower bound.
    """

    GROUPS = 26
    slack = 0.0

    def __init__(self, pivots: list[str], window: int | None = None):
        self.pivots, self.window = pivots, window

    @staticmethod
    def of(names: DataFrame, window: int | None = None, pivots: int = 16, sample: int = 2000) -> EditSpace:
        """Pivots that lie far from each other, from a sample by hash; names: name."""
        some = [r.name for r in names.select("name").orderBy(F.xxhash64("name"), "name").limit(sample).collect()]
        chosen: list[str] = []
        nearest = np.array([len(x) for x in some], np.int64)
        while some and len(chosen) < pivots and nearest.max() > 0:
            chosen.append(some[int(nearest.argmax())])
            nearest = np.minimum(nearest if len(chosen) > 1 else 1 << 30, batch_edit.levenshtein([(chosen[-1], x) for x in some]))
        return EditSpace(chosen, window)

    def coordinates(self, name: Column) -> Column:
        pivots, groups = self.pivots, self.GROUPS

        @F.pandas_udf(T.ArrayType(T.FloatType()))
        def told(names: pd.Series) -> pd.Series:
            texts = list(names)
            out = np.zeros((len(texts), len(pivots) + 1 + groups), np.float32)
            for k, p in enumerate(pivots):
                out[:, k] = batch_edit.levenshtein([(p, x) for x in texts])
            out[:, len(pivots)] = [len(x) for x in texts]
            letters = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
            np.add.at(out, (np.repeat(np.arange(len(texts)), [len(x) for x in texts]), len(pivots) + 1 + letters % groups), 1)
            return pd.Series(list(out))

        return told(name)

    def gap(self, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        n = len(self.pivots)
        over = None if self.window is None else np.maximum(low[None, :, n] - q[:, n, None], q[:, n, None] - high[None, :, n]) > self.window
        q, low, high = (np.ascontiguousarray(np.minimum(x, 127).astype(np.int8).T) for x in (q, low, high))  # what is cut off only makes bounds lower
        less, more = np.zeros((2, q.shape[1], low.shape[1]), np.int16)
        for k in range(n + 1, len(q)):
            less += np.maximum(low[k][None, :] - q[k][:, None], 0)
            more += np.maximum(q[k][:, None] - high[k][None, :], 0)
        out = np.maximum(less, more)
        for k in range(n + 1):
            np.maximum(out, np.maximum(low[k][None, :] - q[k][:, None], q[k][:, None] - high[k][None, :]), out=out)
        out = out.astype(np.float32)
        if over is not None:
            out[over] = np.inf
        return out

    def exact(self, q: np.ndarray, p: np.ndarray, q_text: list, p_text: list) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        one, two = batch_edit.encoded(q_text), batch_edit.encoded(p_text)
        return lambda i, j: batch_edit.levenshtein_rows(*one, *two, i, j)


class Cuts:
    """A tree of cuts for each block that has any; leaves are numbered within the block."""

    def __init__(self, sample: dict[str, np.ndarray], leaves: dict[str, int]):
        self.trees = {b: self._cut(x, leaves[b], [0]) for b, x in sample.items() if len(x)}

    def _cut(self, x: np.ndarray, leaves: int, number: list[int]):
        spread = x.max(0) - x.min(0)
        axis = int(spread.argmax())
        at = float(np.median(x[:, axis]))
        low = x[:, axis] <= at
        if leaves < 2 or spread[axis] == 0 or low.all():
            low = x[:, axis] < at
            if leaves < 2 or spread[axis] == 0 or not low.any():
                number[0] += 1
                return number[0] - 1
            at = float(x[low, axis].max())
        return axis, at, self._cut(x[low], leaves // 2, number), self._cut(x[~low], leaves - leaves // 2, number)

    def leaf(self, block: str, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int32)

        def down(node, at: np.ndarray) -> None:
            if isinstance(node, tuple):
                low = x[at, node[0]] <= node[1]
                down(node[2], at[low])
                down(node[3], at[~low])
            else:
                out[at] = node

        if block in self.trees:
            down(self.trees[block], np.arange(len(x)))
        return out


def _stacked(coords: pd.Series) -> np.ndarray:
    return np.stack(coords.to_numpy()) if len(coords) else np.zeros((0, 1))


def nearest(queries: DataFrame, points: DataFrame, space, k: int | None, bound: float = float("inf"), told: list[int] | None = None) -> DataFrame:
    """The k nearest points of each query in its block, with all that are as near as the k-th (or within the space's slack of it): query, point, distance.

    queries: id, block, coords, text; points the same (text may be null where the space takes none; block null is a block too).
    Distances above bound don't count; with k None all within bound are returned. told gets the number of pairs whose distance was computed.
    Points with the same coordinates can't be cut apart and share a leaf, which is dealt in blocks of POINTS.
    """
    shape = lambda df: df.select("id", F.coalesce(F.col("block").cast("string"), F.lit("")).alias("block"), "coords", F.col("text").cast("string").alias("text"))
    queries, points = materialize(shape(queries), "queries"), materialize(shape(points), "points")
    sizes = {r.block: r.n for r in points.groupBy("block").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LEAF_ROWS).orderBy(F.col("n").desc(), "block").limit(BLOCKS).collect()}
    drawn = points.select("block", "coords").orderBy(F.xxhash64("id"), "block").limit(SAMPLE_ROWS).toPandas() if sizes else pd.DataFrame({"block": [], "coords": []})
    sample = {b: np.stack(x.coords.to_numpy()) for b, x in drawn.groupby("block") if b in sizes}
    cuts = Cuts(sample, {b: min(-(-sizes[b] // LEAF_ROWS), max(1, len(x) // 4)) for b, x in sample.items()})

    @F.pandas_udf(T.IntegerType())
    def leaf(block: pd.Series, coords: pd.Series) -> pd.Series:
        x, out = _stacked(coords), np.zeros(len(block), np.int32)
        for b, at in block.groupby(block).indices.items():
            out[at] = cuts.leaf(b, x[at])
        return pd.Series(out)

    if not sample:  # every block is a leaf, and nothing else is to be met
        packed = _packed(points.withColumn("leaf", F.lit(0)), ["block", "leaf"], POINTS, F.struct("id", "coords", "text"), "points")
        found = materialize(_meet(queries.select("*", F.lit(0).alias("leaf"), F.lit(bound).alias("bound")), packed, space, k), "near")
        return _best(found, k, space.slack, told)
    queries = materialize(queries.withColumn("leaf", leaf("block", "coords")), "placed-queries")
    points = materialize(points.withColumn("leaf", leaf("block", "coords")), "placed-points")
    packed = _packed(points, ["block", "leaf"], POINTS, F.struct("id", "coords", "text"), "points")
    packed = materialize(packed, "leaves")
    boxes = _boxes(points.filter(F.col("block").isin(list(cuts.trees))))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def reached(block: pd.Series, own: pd.Series, coords: pd.Series, within: pd.Series) -> pd.Series:
        """Other leaves whose gap is within the bound, nearest first."""
        x, out = _stacked(coords), [[] for _ in range(len(block))]
        for b, every in block.groupby(block).indices.items():
            if b not in boxes:
                continue
            number, low, high = boxes[b]
            for at in np.array_split(every, -(-len(every) * len(number) // 2**20)):
                gaps = space.gap(x[at], low, high)
                gaps[number[None, :] == own.to_numpy()[at][:, None]] = np.inf
                for i, g in zip(at, gaps, strict=True):
                    hit = np.flatnonzero(g <= within[i]) if np.isfinite(within[i]) else np.flatnonzero(np.isfinite(g))
                    out[i] = number[hit[np.argsort(g[hit], kind="stable")]].tolist()
        return pd.Series(out)

    found = materialize(_meet(queries.withColumn("bound", F.lit(bound)), packed, space, k), "near")
    seen = queries.withColumn("met", F.array("leaf"))
    for most in (*NEAR_LEAVES, None):
        asked = seen.withColumn("bound", F.lit(bound)) if k is None else seen.join(_kth(found, k), "id", "left").withColumn("bound", F.least(F.coalesce(F.col("kth") + space.slack, F.lit(bound)), F.lit(bound))).drop("kth")
        asked = asked.withColumn("_to", F.array_except(reached("block", "leaf", "coords", "bound"), "met"))
        if most is not None:
            asked = asked.withColumn("_to", F.slice("_to", 1, most))
        asked = materialize(asked.withColumn("met", F.concat("met", "_to")), "routes")
        routes = asked.select("id", "block", "coords", "text", "bound", F.explode("_to").alias("leaf"))
        more = materialize(_meet(routes, packed, space, k), "near")
        found = found.unionByName(more)
        seen = asked.drop("_to", "bound")
    return _best(found, k, space.slack, told)


def _best(found: DataFrame, k: int | None, slack: float, told: list[int] | None) -> DataFrame:
    """The k nearest of what was found, and all that are within the slack of the k-th."""
    if told is not None:
        told.append(int(found.filter("point IS NULL").agg(F.sum("distance")).first()[0] or 0))
    found = found.filter("point IS NOT NULL")
    if k is None:
        return found
    rank = F.rank().over(Window.partitionBy("query").orderBy("distance"))
    if not slack:
        return found.withColumn("_r", rank).filter(F.col("_r") <= k).drop("_r")
    kth = F.max(F.when(F.col("_r") <= k, F.col("distance"))).over(Window.partitionBy("query"))
    return found.withColumn("_r", rank).withColumn("_far", kth + slack).filter(F.col("distance") <= F.col("_far")).drop("_r", "_far")


def _packed(rows: DataFrame, by: list[str], size: int, row: Column, name: str) -> DataFrame:
    """Rows of a leaf as arrays of about `size`."""
    counts = rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / size).cast("long").alias("_parts"))
    dealt = rows.join(counts, by).withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts")))
    return dealt.groupBy(*by, "_part").agg(F.collect_list(row).alias(name)).drop("_part")


def _boxes(points: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each block its leaves' numbers, least and largest coordinates. Leaves are at most a quarter of the sample, so these are few."""
    per = points.select("block", "leaf", F.posexplode("coords").alias("k", "v")).groupBy("block", "leaf", "k").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    per = per.groupBy("block", "leaf").agg(F.array_sort(F.collect_list(F.struct("k", "low", "high"))).alias("c"))
    got = per.select("block", "leaf", F.col("c.low").alias("low"), F.col("c.high").alias("high")).toPandas()
    return {b: (x.leaf.to_numpy(np.int32), np.stack(x.low.to_numpy()), np.stack(x.high.to_numpy())) for b, x in got.groupby("block")}


def _kth(found: DataFrame, k: int) -> DataFrame:
    """id, kth: the k-th distance of queries that have so many."""
    best = found.filter("point IS NOT NULL").withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy("distance"))).filter(F.col("_n") == k)
    return best.select(F.col("query").alias("id"), F.col("distance").alias("kth"))


def _within(gaps: np.ndarray, within: np.ndarray, k: int | None, slack: float, exact) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Pairs (i, j) within the bounds with their distances, and how many were computed.

    Points come in order of their gap, k of them, then twice as many and so on, so that what is near gives a bound for the rest.
    """
    within = np.minimum(within, np.finfo(gaps.dtype).max)
    if k is None:
        i, j = np.nonzero(gaps <= within[:, None])
        d = np.asarray(exact(i, j), float)
        keep = d <= within[i]
        return i[keep], j[keep], d[keep], len(d)
    order = np.argsort(gaps, axis=1, kind="stable")
    found, at, step, count = [], 0, k, 0
    best = np.full((len(gaps), k), np.inf)
    while at < gaps.shape[1]:
        some = order[:, at : at + step]
        i, c = np.nonzero(np.take_along_axis(gaps, some, 1) <= within[:, None])
        if not len(i):
            break
        d = np.asarray(exact(i, some[i, c]), float)
        told = np.full(some.shape, np.inf)
        told[i, c] = d
        best = np.partition(np.concatenate([best, told], 1), k - 1, axis=1)[:, :k]
        within = np.minimum(within, best[:, k - 1] + slack)
        found.append((i, some[i, c], d))
        at, step, count = at + step, step * 2, count + len(d)
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0), 0
    i, j, d = (np.concatenate(x) for x in zip(*found, strict=True))
    keep = d <= within[i]
    return i[keep], j[keep], d[keep], count


def _meet(routes: DataFrame, packed: DataFrame, space, k: int | None) -> DataFrame:
    """Queries (id, block, leaf, coords, text, bound) with what is best in the leaf: query, point, distance; a row without point has the number of distances computed."""
    asked = _packed(routes, ["block", "leaf"], QUERIES, F.struct("id", "coords", "text", "bound"), "queries")
    tiles = asked.join(packed, ["block", "leaf"]).select("queries", "points")
    q_type, p_type = (df.schema["id"].dataType.simpleString() for df in (routes, packed.select(F.col("points.id").getItem(0).alias("id"))))

    def side(x: pa.StructScalar | pa.Array) -> tuple[list, np.ndarray, list, pa.Array]:
        rows = x.values
        coords = np.stack([np.asarray(c, float) for c in rows.field("coords").to_pylist()])
        return rows.field("id").to_pylist(), coords, rows.field("text").to_pylist(), rows

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = [b.schema.field("queries").type.value_type.field("id").type, b.schema.field("points").type.value_type.field("id").type, pa.float64()]
            for n in range(b.num_rows):
                (q_id, q, q_text, rows), (p_id, p, p_text, _) = side(b.column(0)[n]), side(b.column(1)[n])
                within = np.asarray(rows.field("bound").to_pylist(), float)
                i, j, d, count = _within(space.gap(q, p, p), within, k, space.slack, space.exact(q, p, q_text, p_text))
                columns = ([q_id[x] for x in i] + [q_id[0]], [p_id[x] for x in j] + [None], [*d.tolist(), float(count)])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["query", "point", "distance"])

    return tiles.mapInArrow(run, f"query {q_type}, point {p_type}, distance double")


def nearest_texts(targets: DataFrame, names: DataFrame, k: int | None, cutoff: int, window: int | None = None, told: list[int] | None = None) -> DataFrame:
    """The k nearest names of each target by edit distance up to cutoff, and all that are as near as the k-th: left_name, right_name, distance.

    targets, names: name, distinct. window bounds the difference of lengths. With k None all names within cutoff.
    """
    space = EditSpace.of(names, window)
    row = lambda df: df.select(F.col("name").alias("id"), F.lit("").alias("block"), space.coordinates(F.col("name")).alias("coords"), F.col("name").alias("text"))
    near = nearest(row(targets), row(names), space, k, float(cutoff), told)
    return near.select(F.col("query").alias("left_name"), F.col("point").alias("right_name"), F.col("distance").cast("int").alias("distance"))
