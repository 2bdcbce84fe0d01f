"""Joins by edit distance, containment, vectors and features."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simloom.functions.distance import cosine, dot, norm
from simloom.functions.text import find_starts
from simloom.operators import nearest
from simloom.storage import join_small, materialize

#: Longest text whose deletion variants are enumerated; longer ones are indexed by segments.
DELETION_LENGTH = 24
#: Texts of a length meet on replaced and moved characters where these are so many times fewer than what deletions leave.
FEWER = 3
#: Rows of a block that is broadcast where every row must meet every other side's row.
BLOCK_ROWS = 5_000
#: Vectors of a tile, vectors and pairs that are a task's work at least, and how far below the k-th similarity rounding to 9 digits reaches.
TILE, TASK_ROWS, TASK_PAIRS, SLACK = 4096, 1024, 2**25, 2e-9
#: Rules that are looked for one by one.
FEW_RULES = 64


def deletions(x: Column, radius: int) -> Column:
    """x and all that is left of it after up to `radius` deletions. They go from left to right, so that each set of places comes once."""

    def less(t: Column) -> Column:
        s, n = t["s"], F.length(t["s"])
        one = lambda i: F.struct(F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, n)).alias("s"), i.alias("at"))
        return F.when(t["at"] <= n, F.transform(F.sequence(t["at"], n), one)).otherwise(F.array().cast("array<struct<s:string,at:int>>"))

    levels = [F.array(F.struct(x.alias("s"), F.lit(1).alias("at")))]
    for _ in range(radius):
        levels.append(F.flatten(F.transform(levels[-1], less)))
    return F.array_distinct(F.flatten(F.array(*[F.transform(v, lambda t: t["s"]) for v in levels])))


def segments(x: Column, radius: int) -> Column:
    """radius + 1 parts of x; a text within the radius keeps one of them whole, moved by radius at most."""
    n, parts = F.length(x), radius + 1

    def part(j: Column) -> Column:
        a, b = F.floor(j * n / parts).cast("int"), F.floor((j + 1) * n / parts).cast("int")
        return F.struct(n.alias("n"), j.alias("j"), F.substring(x, a + 1, b - a).alias("s"))

    return F.transform(F.sequence(F.lit(0), F.lit(radius)), part)


def segment_probes(x: Column, radius: int) -> Column:
    """What x could share with segments() of texts that are shorter or longer by radius at most."""
    parts = radius + 1

    def at(n: Column, j: Column) -> Column:
        a, b = F.floor(j * n / parts).cast("int"), F.floor((j + 1) * n / parts).cast("int")
        low, high = F.greatest(F.lit(0), a - radius), F.least(F.length(x) - (b - a), a + radius)
        starts = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda q: F.struct(n.alias("n"), j.alias("j"), F.substring(x, q + 1, b - a).alias("s")))

    lengths = F.sequence(F.greatest(F.lit(0), F.length(x) - radius), F.length(x) + radius)
    every = F.flatten(F.flatten(F.transform(lengths, lambda n: F.transform(F.sequence(F.lit(0), F.lit(radius)), lambda j: at(n, j)))))
    return F.array_distinct(every)


def varying_places(names: DataFrame, longest: int) -> dict[int, list[int]]:
    """For each length of names: places, from 1, where not all names of that length have the same character. Longer ones count as longest + 1, without places."""
    n = F.least(F.length("name"), F.lit(longest + 1))
    places = F.when((n > 0) & (n <= longest), F.sequence(F.lit(1), n)).otherwise(F.array(F.lit(0)))
    at = names.filter("name IS NOT NULL").select(n.alias("n"), F.explode(places).alias("i"), "name").withColumn("c", F.when(F.col("i") > 0, F.ascii(F.substring("name", F.col("i"), F.lit(1)))).otherwise(0))
    out: dict[int, list[int]] = {}
    for r in at.groupBy("n", "i").agg((F.min("c") != F.max("c")).alias("varies")).orderBy("n", "i").collect():
        out.setdefault(r.n, []).extend([r.i] if r.varies else [])
    return out


def for_length(of: dict[int, Column]) -> Column:
    """The value for a name's length."""
    return F.create_map(*[x for n, v in of.items() for x in (F.lit(n), v)])[F.length("name")]


def replaced_keys(names: DataFrame, places: dict[int, list[int]], radius: int) -> DataFrame:
    """name, _k, _p, _q, _d: what is left of a name without up to `radius` (0 to 2) of its places, and the characters there.

    Names of a length that share _k and differ in _p and in _q (one place: the same twice) differ in just these _d places.
    """
    def at(some: tuple[int, ...], low: int, high: int) -> Column:
        i, j = (some[0], some[-1]) if some else (0, 0)
        return F.struct(*[F.lit(v).alias(k) for k, v in (("i", i), ("j", j), ("low", low), ("high", high), ("d", len(some)))])

    every = {n: F.array(*[at(some, (v or [1])[0], (v or [n])[-1]) for d in range(radius + 1) for some in combinations(v, d)]) for n, v in places.items()}
    rows = names.filter(F.length("name").isin(*places)).select("name", F.explode(for_length(every)).alias("_at")).select("name", "_at.*")
    i, j, low, high = (F.col(c) for c in ("i", "j", "low", "high"))
    cut = lambda start, n: F.substring("name", start, F.greatest(F.lit(0), n))
    key = F.concat(F.char(F.length("name") + 64), F.char(i + 64), F.char(j + 64), cut(low, i - low), cut(i + 1, j - i - 1), cut(j + 1, high - j))
    code = lambda c: F.when(c > 0, F.ascii(F.substring("name", c, F.lit(1)))).otherwise(0)
    return rows.select("name", key.alias("_k"), code(i).alias("_p"), code(j).alias("_q"), F.col("d").alias("_d"))


def moved_keys(names: DataFrame, places: dict[int, list[int]]) -> DataFrame:
    """name, _k, _g, _f, _l: what is left of a name without one character; the run of equal ones that it is from goes from _f to _l, the run before from _g.

    Only runs are taken whose first or last place varies, as only there two names can begin or end to differ.
    """
    low = for_length({n: F.lit((v or [n])[0]) for n, v in places.items()})
    vary = for_length({n: F.array(*[F.lit(i) for i in v]).cast("array<int>") for n, v in places.items()})
    char = lambda c: F.substring("name", c, F.lit(1))
    n, at = F.length("name"), F.col("_l")
    rows = names.filter(n.isin(*places)).select("name", low.alias("_low"), vary.alias("_v")).select("*", F.explode(F.sequence("_low", n)).alias("_l"))
    rows = rows.filter((at == n) | (char(at) != char(at + 1)))
    begin = lambda end: F.length(F.rtrim(F.substring("name", F.lit(1), end), char(end))) + 1
    rows = rows.withColumn("_f", begin(at)).filter("array_contains(_v, _f) OR array_contains(_v, _l)")
    rows = rows.withColumn("_g", F.when(F.col("_f") > 1, begin(F.col("_f") - 1)).otherwise(0))
    key = F.concat(F.char(n + 64), F.substring("name", F.col("_low"), at - F.col("_low")), F.substring("name", at + 1, n - at))
    return rows.select("name", key.alias("_k"), "_g", "_f", "_l")


def range_join(left: DataFrame, right: DataFrame, radius: int) -> DataFrame:
    """All (left_name, right_name, distance) of edit distance up to radius. Both sides: name, distinct.

    Up to radius 2, texts meet on what is left after deletions; long texts, and larger radii, meet on
    a shared segment. Texts at distance d have something left after d deletions at most in common, so
    where they meet after more they are passed over. Candidates are verified with a cutoff, then made distinct.

    Where many places of a length have the same character in all names (numbered names), what is left after deletions
    is shared by far more than are near. Texts of one such length meet on what is left but for
    replaced places that vary, or for one character that moved. Both say the distance, and bring each pair once: a
    pair that differs in up to two places is left to the former, and one that can be told by either's
    moved character counts where the left's goes from the first difference. So nothing is verified or made distinct.

    Rows with keys are many times the names, which Spark's estimates of sizes don't show: it would take
    them for small and collect them for a broadcast. So both sides are always shuffled,
    into a fixed number of parts, as keys compress so well that few parts would be left of them.
    """
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = left.select("name"), right.select("name")

    def meet(keyed: Callable[[DataFrame], DataFrame], one: DataFrame, two: DataFrame) -> DataFrame:
        """Pairs of rows that share _k; columns but for the key are called left_ and right_."""
        def side(df: DataFrame, prefix: str) -> DataFrame:
            dealt = keyed(df).repartition(parts, "_k")
            return dealt.select("_k", *[F.col(c).alias(prefix + c) for c in dealt.columns if c != "_k"]).hint("merge")

        return side(one, "left_").join(side(two, "right_"), "_k")

    def verified(met: DataFrame, least: Column, wanted: Column) -> DataFrame:
        told = met.filter(wanted).withColumn("distance", F.levenshtein("left_name", "right_name", radius))
        return told.filter(F.col("distance") >= least).select("left_name", "right_name", "distance").distinct()

    n_left, n_right = F.length("left_name"), F.length("right_name")
    exploded = lambda keys: lambda df: df.withColumn("_k", F.explode(keys(F.col("name"), radius)))
    found = []
    wanted = F.lit(True)
    if radius <= 2:
        short = DELETION_LENGTH + radius
        places = varying_places(a if left is right else a.unionByName(b), short)
        lengths = [n for n in places if n <= short]
        rows = {n: sum(comb(len(places[n]), d) for d in range(radius + 1)) + (len(places[n]) if radius == 2 else 0) for n in lengths}
        alike = {n: places[n] for n in lengths if FEWER * rows[n] <= sum(comb(n, d) for d in range(radius + 1))}
        if alike:
            met = meet(lambda df: replaced_keys(df, alike, radius), a, b)
            met = met.filter("left__d = 0 OR left__p != right__p AND left__q != right__q")
            found.append(met.select("left_name", "right_name", F.col("left__d").alias("distance")))
        if alike and radius == 2:
            met = meet(lambda df: moved_keys(df, alike), a, b)
            either = "substring(right_name, right__l, left__f - right__l) = substring(left_name, right__l + 1, left__f - right__l)"
            met = met.filter(f"left__l < right__f AND right__g > left__l OR right__l < left__f AND left__g > right__l AND NOT {either}")
            found.append(met.select("left_name", "right_name", F.lit(2).alias("distance")))
        others = [n for n in lengths if n not in alike or any(0 < abs(m - n) <= radius for m in lengths)]
        if others:
            one, two = (df.filter(F.length("name").isin(*others)) for df in (a, b))
            apart = (n_left != n_right) | ~n_left.isin(*alike) if alike else wanted
            found.append(verified(meet(exploded(deletions), one, two), F.greatest(n_left, n_right) - F.length("_k"), apart))
        if found and short + 1 not in places:
            return found[0] if len(found) == 1 else reduce(DataFrame.union, found)
        a, b = a.filter(F.length("name") > DELETION_LENGTH), b.filter(F.length("name") > DELETION_LENGTH)
        wanted = F.greatest(n_left, n_right) > short
    one = exploded(segment_probes)(a).repartition(parts, "_k").withColumnRenamed("name", "left_name").hint("merge")
    two = exploded(segments)(b).repartition(parts, "_k").withColumnRenamed("name", "right_name").hint("merge")
    found.append(verified(one.join(two, "_k"), F.lit(0), wanted))
    return reduce(DataFrame.union, found)


def nearest_names(targets: DataFrame, names: DataFrame, k: int, window: int = 5, cutoff: int = 5, fallback: int = 8) -> DataFrame:
    """The k nearest names of each target: target, neighbor, distance, length_delta, rank.

    targets: name; names: name, key (its uniqueness key). Names within the length window and the
    cutoff come first, then up to the fallback; of a key one name counts, and never the target's own.
    """
    first = materialize(names.groupBy("key").agg(F.min("name").alias("name")), "names")
    keys = first.select(F.col("name").alias("right_name"), "key")
    own = names.select(F.col("name").alias("left_name"), F.col("key").alias("own_key")).distinct()
    most = max(cutoff, fallback)
    asked = materialize(targets.select("name").distinct(), "targets")

    def others(pairs: DataFrame) -> DataFrame:
        return materialize(join_small(join_small(pairs, keys, "right_name"), own, "left_name", "left").filter("own_key IS NULL OR key != own_key").select("left_name", "right_name", "distance"), "near")

    # what deletions find is all that is within 2; whoever has k of them needs no more, the others are searched by cuts of space
    pairs = others(range_join(asked, first.select("name"), min(2, most)).filter(F.abs(F.length("left_name") - F.length("right_name")) <= window))
    if most > 2:
        served = pairs.groupBy(F.col("left_name").alias("name")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= k)
        short = materialize(asked.join(served, "name", "left_anti"), "short")
        if short.limit(1).count():  # one name more, as a target's own may be among them
            wide = others(nearest.nearest_texts(short, first.select("name"), k + 1, most, window))
            pairs = pairs.join(short.select(F.col("name").alias("left_name")), "left_name", "left_anti").unionByName(wide)
    order = Window.partitionBy("left_name").orderBy(F.col("distance") > cutoff, "distance", "right_name")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("left_name").alias("target"), F.col("right_name").alias("neighbor"), "distance", (F.length("right_name") - F.length("left_name")).alias("length_delta"), "rank")


def pick_at_distance(targets: DataFrame, names: DataFrame, goal: int, reach: int, pool: int = 16, seed: int = 0) -> DataFrame:
    """One name for each target, at the goal distance if there is any, else the nearest to it.

    The least radius from goal to reach at which anything lies decides; of up to `pool` names there
    one is drawn by hash. Targets that nothing is near get the name of the nearest length.
    """
    pairs = range_join(targets.select("name").distinct(), names.select("name").distinct(), reach).filter("left_name != right_name")
    tier = F.when(F.col("distance") <= goal, goal).otherwise(F.col("distance"))
    best = pairs.withColumn("_tier", tier).withColumn("_least", F.min("_tier").over(Window.partitionBy("left_name"))).filter("_tier = _least")
    exact = F.col("distance") == goal
    any_exact = F.max(exact.cast("int")).over(Window.partitionBy("left_name")) == 1
    best = best.withColumn("_any", any_exact).filter(exact | ~F.col("_any"))
    order = Window.partitionBy("left_name").orderBy(F.abs(F.col("distance") - goal), "distance", F.abs(F.length("left_name") - F.length("right_name")), "right_name")
    best = best.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= pool)
    drawn = F.min_by(F.struct("right_name", "distance", "_any"), F.sha2(F.concat_ws("|", F.lit(seed), "left_name", "right_name").cast("binary"), 256))
    picked = best.groupBy("left_name").agg(drawn.alias("p")).select(F.col("left_name").alias("target"), F.col("p.right_name").alias("neighbor"), F.col("p.distance").alias("distance"), F.when(F.col("p._any"), "exact_target").otherwise("nearest_available").alias("mode"))
    picked = materialize(picked, "picked")
    rest = targets.select(F.col("name").alias("target")).distinct().join(picked, "target", "left_anti")
    if not rest.limit(1).count():
        return picked
    # two names of each length are enough; lengths are few, and meet each other
    by_length = names.select("name", F.length("name").alias("_l")).distinct().withColumn("_m", F.row_number().over(Window.partitionBy("_l").orderBy("name"))).filter("_m <= 2")
    wanted = rest.groupBy(F.length("target").alias("_t")).agg(F.count(F.lit(1)).alias("_c")).select("_t")
    near = join_blocks(wanted, by_length, lambda w, n: w.join(n))
    near = near.withColumn("_n", F.row_number().over(Window.partitionBy("_t").orderBy(F.abs(F.col("_l") - F.col("_t")), "name"))).filter("_n <= 2")
    near = near.groupBy("_t").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "name"))), lambda s: s["name"]).alias("_names"))
    far = rest.withColumn("_t", F.length("target")).join(near, "_t").withColumn("neighbor", F.try_element_at(F.filter("_names", lambda v: v != F.col("target")), F.lit(1))).filter("neighbor IS NOT NULL")
    return picked.unionByName(far.select("target", "neighbor", F.levenshtein("target", "neighbor").alias("distance"), F.lit("global_length_fallback").alias("mode")))


def length_ring(targets: DataFrame, names: DataFrame, count: int, reach: int = 4) -> DataFrame:
    """For each target the names of the nearest lengths, radius by radius until there are count (the last radius whole).

    A target with no name of a length within reach gets all names.
    """
    lengths = names.groupBy(F.length("name").alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    own = targets.select(F.length("name").alias("_t")).distinct()
    rings = own.withColumn("_l", F.explode(F.sequence(F.col("_t") - reach, F.col("_t") + reach))).join(lengths, "_l")
    rings = rings.withColumn("_r", F.abs(F.col("_l") - F.col("_t")))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_t").orderBy("_r").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rings = rings.withColumn("_before", before).filter(F.col("_before") < count).select("_t", "_l", "_r")
    pool = names.select(F.col("name").alias("candidate"), F.length("name").alias("_l"))
    asked = targets.select(F.col("name").alias("target"), F.length("name").alias("_t"))
    near = asked.join(rings, "_t").join(pool, "_l").filter("target != candidate").select("target", "candidate", F.col("_r").alias("radius"))
    alone = materialize(asked.filter("target IS NOT NULL").join(rings.select("_t").distinct(), "_t", "left_anti"), "alone")
    if not alone.limit(1).count():
        return near
    every = join_blocks(pool, alone, lambda p, a: p.join(a)).filter("target != candidate")
    return near.unionByName(every.select("target", "candidate", F.abs(F.col("_l") - F.col("_t")).alias("radius")))


def contains_join(rules: DataFrame, names: DataFrame, most: int | None = None, scan_order: bool = True, seed: int = 0) -> DataFrame:
    """Every occurrence of each rule's source in each name: source, name, start.

    rules: source; names: name, row_idx. Few rules are looked for one by one in each name. More of them
    are met by equality with the name's n-grams of the lengths that rules have. With most, that many
    examples of a rule: the first in scan order, or a hash sample.
    """
    sources = rules.select("source").distinct().filter("length(source) > 0")
    few = [r[0] for r in sources.limit(FEW_RULES + 1).collect()]
    none = F.array().cast("array<string>")
    if len(few) <= FEW_RULES:
        held = F.filter(F.array(none, F.array(*[F.lit(w) for w in few]).cast("array<string>"))[1], lambda w: F.contains(F.col("name"), w))
        met = names.select("name", "row_idx", F.explode(held).alias("source"))
    else:
        widths = [r[0] for r in sources.select(F.length("source")).distinct().collect()]

        def cut(w: int) -> Column:
            return F.when(F.length("name") >= w, F.transform(F.sequence(F.lit(1), F.length("name") - w + 1), lambda i: F.substring(F.col("name"), i, F.lit(w)))).otherwise(none)

        grams = F.flatten(F.array(none, *[cut(w) for w in widths]))
        met = names.select("name", "row_idx", F.explode(F.array_distinct(grams)).alias("source")).join(sources, "source")
    out = met.withColumn("start", F.explode(find_starts(F.col("name"), F.col("source"))))
    if most is None:
        return out.select("source", "name", "row_idx", "start")
    by = ["row_idx", "start"] if scan_order else [F.sha2(F.concat_ws("|", F.lit(seed), "source", "name", "start").cast("binary"), 256)]
    return out.withColumn("_n", F.row_number().over(Window.partitionBy("source").orderBy(*by))).filter(F.col("_n") <= most).select("source", "name", "row_idx", "start")


def join_blocks(rows: DataFrame, small: DataFrame, pair: Callable[[DataFrame, DataFrame], DataFrame], block: int = BLOCK_ROWS) -> DataFrame:
    """pair(rows, part) for every part of `small`, united. Parts have about `block` rows at most, so each can be broadcast."""
    parts = max(1, -(-small.count() // block))
    number = F.pmod(F.xxhash64(*[F.col(c) for c in small.columns]), F.lit(parts))
    found = None
    for n in range(parts):
        some = pair(rows, F.broadcast(small if parts == 1 else small.filter(number == n)))
        found = some if found is None else found.unionByName(some)
    return found


def _best_of_tile(x: tuple[np.ndarray, ...], q: tuple[np.ndarray, ...], k: int, floor: np.ndarray) -> tuple[np.ndarray, ...]:
    """The k best vectors of a tile for each query, and what rounding may put before them: places of queries, ids, similarities.

    x, q: ids, rows, norms. One product of matrices tells what is near the k-th; only that is scored by sums in order, as
    SQL does. Of equal similarities the k least ids are enough. floor: each query's k-th so far, raised here.
    """
    (ids, rows, norms), (own, asked, asked_norms) = x, q
    columns, wanted = np.ascontiguousarray(rows.T), np.ascontiguousarray(asked.T)
    scores = (asked / asked_norms[:, None]) @ (columns / norms)
    scores[own[:, None] == ids[None, :]] = -np.inf
    least = floor.copy()
    if len(ids) >= k:
        least = np.maximum(least, np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k])
    i, j = np.nonzero((scores >= least[:, None] - SLACK) & (scores > -np.inf))
    s = np.zeros(len(i))
    for d in range(len(columns)):
        s += wanted[d][i] * columns[d][j]
    s /= asked_norms[i] * norms[j]
    order = np.lexsort((ids[j], -s, i))
    i, j, s = i[order], j[order], s[order]
    new = np.ones(len(i), bool)
    new[1:] = i[1:] != i[:-1]
    place = np.arange(len(i))
    start = np.flatnonzero(new)
    number = place - np.repeat(start, np.diff(np.append(start, len(i))))
    kth = number == k - 1
    floor[i[kth]] = np.maximum(floor[i[kth]], s[kth])
    new[1:] |= s[1:] != s[:-1]
    start = np.flatnonzero(new)
    same = place - np.repeat(start, np.diff(np.append(start, len(i))))
    keep = (same < k) & (s >= floor[i] - SLACK)
    return i[keep], ids[j[keep]], s[keep]


def knn_cosine(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The k vectors (id, vector) of the highest cosine for each query (query_id, query): exact, ties by id. Ids are whole numbers.

    Queries go in blocks, of which each is broadcast and meets the vectors where they lie, in tiles, as products of
    matrices; a tile gives some k rows for each query, so vectors aren't shuffled by query. Vectors of another length
    than most, or without a finite norm, meet the others one by one.
    """
    width = vectors.agg(F.mode(F.size("vector"))).first()[0] or 0
    told = lambda df, name: df.withColumn("_n", F.greatest(norm(F.col(name)), F.lit(1e-6))).withColumn("_odd", ~F.coalesce((F.size(name) == width) & (norm(F.col(name)) < 1e100), F.lit(False)))
    v, q = told(vectors.select("id", "vector"), "vector"), told(queries.select("query_id", "query"), "query")
    asked = materialize(q.filter("NOT _odd AND query_id IS NOT NULL").select(F.col("query_id").cast("long"), F.col("query").cast("array<double>"), "_n"), "asked")
    rows = v.filter("NOT _odd AND id IS NOT NULL").select(F.col("id").cast("long"), F.col("vector").cast("array<double>"), "_n")
    many, size = asked.count(), rows.count()
    rows = materialize(rows.repartition(max(1, min(-(-many * size // TASK_PAIRS), -(-size // TASK_ROWS)))), "vectors")
    kinds = [vectors.schema["id"].dataType, queries.schema["query_id"].dataType]
    schema = "query_id long, id long, similarity double"
    found = vectors.sparkSession.createDataFrame([], schema)
    blocks = -(-many // BLOCK_ROWS)
    for n in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n).toArrow()
        if not block.num_rows:
            continue
        shared = vectors.sparkSession.sparkContext.broadcast(_arrays(block, width))

        def search(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, some, norms = shared.value
            floor = np.full(len(own), -np.inf)
            for b in batches:
                for tile in (b.slice(at, TILE) for at in range(0, b.num_rows, TILE)):
                    x = _arrays(tile, width)
                    for at in range(0, len(own), TILE // 16):
                        s = slice(at, at + TILE // 16)
                        i, ids, scores = _best_of_tile(x, (own[s], some[s], norms[s]), k, floor[s])
                        yield pa.RecordBatch.from_arrays([pa.array(own[s][i]), pa.array(ids), pa.array(scores)], names=["query_id", "id", "similarity"])

        near = rows.mapInArrow(search, schema).withColumn("similarity", F.round("similarity", 9))
        found = found.unionByName(materialize(_ranked(near, k).drop("rank"), "near"))
        shared.destroy()
    found = found.select(F.col("query_id").cast(kinds[1]).alias("query_id"), F.col("id").cast(kinds[0]).alias("id"), "similarity")
    for some, others in ((v.filter("_odd"), q), (v.filter("NOT _odd"), q.filter("_odd"))):
        if (some if others is q else others).limit(1).count():
            nv, nq = F.col("_nv"), F.col("_nq")
            pairs = join_blocks(some.select("id", "vector", F.col("_n").alias("_nv")), others.select("query_id", "query", F.col("_n").alias("_nq")), lambda v, q: v.join(q, F.col("id") != F.col("query_id")))
            found = found.unionByName(pairs.select("query_id", "id", F.round(dot(F.col("query"), F.col("vector")) / (nq * nv), 9).alias("similarity")))
    return _ranked(found, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _arrays(rows: pa.Table | pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors as a matrix, and norms."""
    ids, vectors, norms = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in rows.columns)
    return np.asarray(ids), np.asarray(vectors.flatten()).reshape(len(ids), width), np.asarray(norms)


def nearest_prototype(vectors: DataFrame, prototypes: DataFrame) -> DataFrame:
    """For each vector (id, vector) the prototype (label, prototype) of the highest dot product; ties go to the least label."""
    pairs = join_blocks(vectors, prototypes, lambda v, p: v.join(p)).withColumn("_s", F.round(dot(F.col("vector"), F.col("prototype")), 9))
    best = F.max_by(F.struct("label", "_s"), F.struct("_s", (-F.col("label")).alias("_l")))
    return pairs.groupBy("id").agg(best.alias("b")).select("id", F.col("b.label").alias("label"), F.col("b._s").alias("similarity"))


def similar_to_sources(sources: DataFrame, candidates: DataFrame, least: float, margin: float = 0.0) -> DataFrame:
    """Candidates (id, vector) that are near a source (source, vector) and not as near to any other.

    Every candidate meets every source, in blocks of sources, of which it keeps the two nearest and
    those that are near enough; only these are grouped. Returns source, id, similarity, other,
    other_similarity, margin.
    """
    near = lambda v, s: F.struct((-F.round(cosine(v, s["v"]), 9)).alias("n"), s["source"].alias("source"))
    block = sources.select(F.struct("source", F.col("vector").alias("v")).alias("s"), F.pmod(F.xxhash64("source"), F.lit(max(1, -(-sources.count() // BLOCK_ROWS)))).alias("_b"))
    block = block.groupBy("_b").agg(F.collect_list("s").alias("_s")).drop("_b")
    per = join_blocks(candidates.select("id", "vector"), block, lambda c, s: c.join(s), block=1).select("id", F.array_sort(F.transform("_s", lambda s: near(F.col("vector"), s))).alias("_all"))
    per = per.select("id", F.filter("_all", lambda s, i: (i < 2) | (s["n"] <= -least)).alias("_all"))
    per = per.groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("_all"))).alias("_all"))
    first, second = F.get("_all", F.lit(0)), F.get("_all", F.lit(1))
    rows = per.select("id", F.explode("_all").alias("s"), first.alias("f"), second.alias("g")).filter(F.col("s.n") <= -least)
    other = F.when(F.col("s.source") == F.col("f.source"), F.col("g")).otherwise(F.col("f"))
    rows = rows.select(F.col("s.source").alias("source"), "id", (-F.col("s.n")).alias("similarity"), other["source"].alias("other"), (-other["n"]).alias("other_similarity"))
    rows = rows.withColumn("margin", F.round(F.col("similarity") - F.coalesce("other_similarity", F.lit(0.0)), 9))
    return rows.filter(F.col("margin") >= margin)


def nearest_by_features(rows: DataFrame, candidates: DataFrame, features: list[str], weight: float = 0.15, best: int = 8, seed: int = 0, told: list[int] | None = None) -> DataFrame:
    """For each row one of the `best` candidates of its block, nearest in features and distance.

    rows: id, block, distance and features; candidates the same, none of them null (a null block has no candidates). The objective is the Euclidean
    distance of the features plus weight times the difference of distances, rounded to 9 digits, ties by candidate; of the best ones a hash draws. Found by cuts of
    the feature space (nearest.nearest), so no task holds a block; told gets the number of pairs compared.
    """
    every = [*features, "distance"]
    of = lambda df: df.filter("block IS NOT NULL").select("id", "block", F.array(*[F.col(c).cast("double") for c in every]).alias("coords"), F.lit(None).alias("text"))
    near = nearest.nearest(of(rows), of(candidates), nearest.FeatureSpace(weight), best, told=told)
    near = near.withColumn("objective", F.round("distance", 9)).withColumnsRenamed({"query": "id", "point": "candidate"})
    near = near.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("objective", "candidate"))).filter(F.col("_n") <= best)
    drawn = F.min_by(F.struct("candidate", "objective"), F.sha2(F.concat_ws("|", F.lit(seed), "id", "candidate").cast("binary"), 256))
    return near.groupBy("id").agg(drawn.alias("p")).select("id", "p.candidate", "p.objective")


def checked_join(left: DataFrame, right: DataFrame, on: list[str], relation: str = "many_to_one", complete: bool = False) -> DataFrame:
    """Left join that raises if keys repeat where `relation` (one_to_one, many_to_one) doesn't allow it, or, if complete, if a row finds nothing."""
    twice = lambda df: df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").limit(1).count()
    if twice(right):
        raise ValueError(f"keys {on} repeat on the right of a {relation} join")
    if relation == "one_to_one" and twice(left):
        raise ValueError(f"keys {on} repeat on the left of a one_to_one join")
    if complete and left.join(right, on, "left_anti").limit(1).count():
        raise ValueError(f"rows without a match for {on}")
    return left.join(right, on, "left")


def sample_of_both(left: DataFrame, right: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """For keys on both sides, one row of each side, drawn by hash: key, left_value, right_value (columns: key, value)."""
    drawn = lambda df, side: df.groupBy(key).agg(F.min_by("value", F.sha2(F.concat_ws("|", F.lit(f"{seed}{side}"), key, "value").cast("binary"), 256)).alias(f"{side}_value"))
    return drawn(left, "left").join(drawn(right, "right"), key)
