"""Unique assignment and matched allocation: sequential rules as rounds over all rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from simloom.operators.metrics import numbered
from simloom.storage import materialize, shuffled


#: Places of a list that a round looks at for a row that was turned down, and rows of a list that are ordered together.
LOOK, BLOCK = 16, 4096
#: Rows and places of lists that are few enough for one task, which takes the turns as they are.
TURNS = 2_000_000


def assign_unique(preferences: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """What rows get if each in turn, by row_idx, takes its best key that is still free.

    preferences: row_idx, pref (its order of choice, from 1), key. taken: key, what nobody may have.
    Returns row_idx, key, pref of the rows that got one. Rows with the same preferences share a list
    (assign_lists), found by sums of hashes, so that no row's preferences are ever gathered.
    """
    p = preferences if taken is None else preferences.join(taken.select("key").distinct(), "key", "left_anti")
    p = materialize(p.groupBy("row_idx", "key").agg(F.min("pref").alias("pref")), "preferences")
    of = ["_a", "_b", "_n"]
    told = p.groupBy("row_idx").agg(F.bit_xor(F.xxhash64("pref", "key")).alias("_a"), F.bit_xor(F.xxhash64("key", F.lit(7), "pref")).alias("_b"), F.count(F.lit(1)).alias("_n"))
    told = materialize(told, "digests")
    rows = told.join(told.groupBy(*of).agg(F.min("row_idx").alias("list")), of).select("row_idx", "list")
    rows = materialize(rows, "rows")
    lists = p.join(rows.filter("row_idx = list").select("row_idx"), "row_idx").withColumnRenamed("row_idx", "list")
    return assign_lists(rows, lists)


def assign_lists(rows: DataFrame, lists: DataFrame, taken: DataFrame | None = None, more: Callable[[DataFrame], DataFrame | None] | None = None, told: list[int] | None = None) -> DataFrame:
    """What rows get if each in turn, by row_idx, takes the first key of its list that is free.

    rows: row_idx, list and maybe first, a key that the row tries before its list (null: none). lists: list, pref, key;
    taken: key. more(lists that rows have come to the end of: list) may give further rows of lists, which
    stand behind those there are, or None when there are no others. Returns row_idx, key, pref (0 for first, null if pref is no number). told gets the number of rounds.

    The turns are a serial dictatorship, which equals deferred acceptance where keys prefer the least row:
    a row that asks for a key because all that it likes better are gone takes it from all later ones.
    Each round every row asks for the first key of its list that it may still get. Rows of one list can't
    get the same key, nor one before what an earlier row of the list gets, so the k-th of them begins at
    the k-th place, and whenever one moves the later ones move with it: a list that n rows share takes
    one round, not n. What a round costs are joins of narrow rows; only rows that move look at lists.
    Up to TURNS rows and places there are no rounds: one task takes the turns, with the same result.
    """
    forbidden = None if taken is None else materialize(taken.select("key").distinct(), "taken")

    def turns(asking: DataFrame, places: DataFrame, gone: DataFrame | None) -> DataFrame | None:
        """row_idx, key, pref by the turns themselves, in one task; None where rows and places are too many for it."""
        if asking.limit(TURNS + 1).count() + places.limit(TURNS + 1).count() > TURNS:
            return None
        first = F.col("first") if "first" in asking.columns else F.lit(None).cast(places.schema["key"].dataType)
        asked = asking.select("row_idx", "list", first.alias("first"))
        if gone is not None:
            asked = asked.join(gone.select(F.col("key").alias("first"), F.lit(True).alias("_no")), "first", "left").select("row_idx", "list", F.when(F.col("_no").isNull(), F.col("first")).alias("first"))
        key = places.schema["key"].dataType.simpleString()
        # numbers stand for rows and lists, so that only these and keys go to the task
        one = materialize(asked.withColumn("_row", F.row_number().over(Window.orderBy("row_idx"))).withColumn("_list", F.xxhash64("list")), "turns")
        listed = places.withColumn("_list", F.xxhash64("list"))

        def take(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            right = right.sort_values(["_list", "pos"], kind="stable")
            numbers, starts = np.unique(right["_list"].to_numpy(), return_index=True)
            at, stop = dict(zip(numbers.tolist(), starts.tolist(), strict=True)), dict(zip(numbers.tolist(), [*starts[1:].tolist(), len(right)][: len(numbers)], strict=True))
            keys, pos, used, out = right["key"].tolist(), right["pos"].tolist(), set(), []
            left = left.sort_values("_row")
            for r, name, own in zip(left["_row"].tolist(), left["_list"].tolist(), left["first"].tolist(), strict=True):
                if own is not None and own == own and own not in used:
                    used.add(own)
                    out.append((r, own, 0))
                    continue
                k = at.get(name)
                if k is None:
                    continue
                while k < stop[name] and keys[k] in used:  # what is gone is gone for later rows of the list too
                    k += 1
                at[name] = k
                if k < stop[name]:
                    used.add(keys[k])
                    out.append((r, keys[k], pos[k]))
            return pd.DataFrame(out, columns=["_row", "_key", "pos"])

        whole = lambda df, *c: df.select(*c, F.lit(1).alias("_all")).groupBy("_all")
        got = whole(one, "_row", "_list", "first").cogroup(whole(listed, "_list", "pos", "key")).applyInPandas(take, f"_row long, _key {key}, pos long")
        told = got.join(shuffled(one.select("_row", "row_idx", "list")), "_row").join(shuffled(places.select("list", "pos", "pref")), ["list", "pos"], "left")
        kind = places.schema["pref"].dataType
        pref = F.when(F.col("pos") == 0, F.lit(0 if isinstance(kind, NumericType) else None).cast(kind)).otherwise(F.col("pref"))
        return told.select("row_idx", F.col("_key").alias("key"), pref.alias("pref"))

    def placed(some: DataFrame, after: DataFrame | None) -> DataFrame:
        """list, pos, key, pref: places in the list, behind those of `after` (list, last)."""
        free = some if forbidden is None else some.join(shuffled(forbidden), "key", "left_anti")
        one = numbered(free.groupBy("list", "key").agg(F.min("pref").alias("pref")), "list", ["pref", "key"], "pos")
        if after is not None:
            one = one.join(shuffled(after), "list", "left").withColumn("pos", F.col("pos") + F.coalesce("last", F.lit(0)))
        return materialize(one.select("list", "pos", "key", "pref"), "places")

    entries = placed(lists, None)
    if (few := turns(rows, entries, forbidden)) is not None:
        while True:
            got = materialize(few, "assigned")
            ended = rows.join(got.select("row_idx"), "row_idx", "left_anti").select("list").distinct() if more is not None else None
            extra = None if ended is None or not ended.limit(1).count() else more(materialize(ended, "ended"))
            if extra is None:
                if told is not None:
                    told.append(0)
                return got
            last = entries.groupBy("list").agg(F.max("pos").alias("last"))
            entries = materialize(entries.unionByName(placed(extra.join(entries.select("list", "key"), ["list", "key"], "left_anti"), last)), "places")
            if (few := turns(rows, entries, forbidden)) is None:
                break
    ends = materialize(entries.groupBy("list").agg(F.max("pos").alias("last")), "ends")
    state = numbered(rows.select("row_idx", "list", F.col("first") if "first" in rows.columns else F.lit(None).cast(entries.schema["key"].dataType).alias("first")), "list", ["row_idx"], "_n")
    state = state.join(shuffled(ends), "list", "left").withColumn("last", F.coalesce("last", F.lit(0))).withColumn("block", F.floor((F.col("_n") - 1) / BLOCK).cast("long"))
    if forbidden is not None:
        state = state.join(forbidden.select(F.col("key").alias("first"), F.lit(True).alias("_no")), "first", "left").withColumn("first", F.when(F.col("_no").isNull(), F.col("first")))
    columns = ["row_idx", "list", "last", "block", "pos", "key", "pref", "moved"]
    kind = entries.schema["pref"].dataType
    zero = F.lit(0 if isinstance(kind, NumericType) else None).cast(kind)
    # at place 0 a row asks for its first key; a key that is null is still to be looked for
    judged = state.select("row_idx", "list", "last", "block", F.when(F.col("first").isNull(), 1).otherwise(0).cast("long").alias("pos"), F.col("first").alias("key"), F.when(F.col("first").isNotNull(), zero).alias("pref"), F.lit(True).alias("moved"))
    judged, holders, n = materialize(_pushed(judged), "asked"), None, 0

    def looked(some: DataFrame) -> DataFrame:
        """Rows at the first place from pos on that they may still get, of the next LOOK."""
        wish = some.filter("key IS NULL AND pos <= last").select("row_idx", "list", F.explode(F.sequence("pos", F.least(F.col("pos") + (LOOK - 1), F.col("last")))).alias("pos")).join(shuffled(entries), ["list", "pos"])
        if holders is not None:
            wish = wish.join(shuffled(holders), "key", "left").filter("holder IS NULL OR holder >= row_idx")
        best = wish.groupBy("row_idx").agg(F.min(F.struct("pos", "key", "pref")).alias("_b"))
        out = some.join(shuffled(best), "row_idx", "left")
        asks = F.col("key").isNotNull()
        place = F.when(asks, F.col("pos")).otherwise(F.coalesce(F.col("_b.pos"), F.least(F.col("pos") + LOOK, F.greatest(F.col("last") + 1, F.col("pos")))))
        return out.select("row_idx", "list", "last", "block", place.alias("pos"), F.coalesce("key", "_b.key").alias("key"), F.coalesce("pref", "_b.pref").alias("pref"), "moved")

    while True:
        while judged.filter("moved").limit(1).count():
            n += 1
            state = materialize(judged.filter("NOT moved").unionByName(looked(judged.filter("moved"))), "asked")
            asked = state.filter("moved AND key IS NOT NULL").groupBy("key").agg(F.min("row_idx").alias("holder"))
            holders = materialize(asked if holders is None else holders.unionByName(asked).groupBy("key").agg(F.min("holder").alias("holder")), "holders")
            lost = F.coalesce(F.col("holder") < F.col("row_idx"), F.lit(False))
            seeks = F.col("key").isNull() & (F.col("pos") <= F.col("last"))
            met = state.join(shuffled(holders), "key", "left").withColumn("_lost", lost).withColumn("moved", F.col("_lost") | seeks)
            met = met.select("row_idx", "list", "last", "block", (F.col("pos") + F.col("_lost").cast("int")).alias("pos"), F.when(~F.col("_lost"), F.col("key")).alias("key"), F.when(~F.col("_lost"), F.col("pref")).alias("pref"), "moved")
            judged = materialize(_pushed(met.select(*columns)), "asked")
        ended = judged.filter("key IS NULL").select("list").distinct()
        extra = None if more is None or not ended.limit(1).count() else more(materialize(ended, "ended"))
        if extra is None:
            break
        new = placed(extra.join(entries.select("list", "key"), ["list", "key"], "left_anti"), ends)
        if new.limit(1).count():
            entries = materialize(entries.unionByName(new), "places")
            ends = materialize(entries.groupBy("list").agg(F.max("pos").alias("last")), "ends")
            judged = judged.drop("last").join(ends, "list", "left").withColumn("last", F.coalesce("last", F.lit(0)))
            judged = materialize(judged.withColumn("moved", F.col("key").isNull() & (F.col("pos") <= F.col("last"))).select(*columns), "asked")
    if told is not None:
        told.append(n)
    return judged.filter("key IS NOT NULL").select("row_idx", "key", "pref")


def _pushed(state: DataFrame) -> DataFrame:
    """Rows of one list, in their order, at least one place apart; those that move look for a key again.

    With r rows of the list up to a row, it stands at r plus the largest (place - r) so far. Both are
    taken within blocks of a list and then over blocks, so that no task orders a whole list.
    """
    rows = state.filter("pos > 0")
    inner = Window.partitionBy("list", "block").orderBy("row_idx")
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_r", F.row_number().over(inner).cast("long")).withColumn("_m", F.max(F.col("pos") - F.col("_r")).over(upto))
    blocks = rows.groupBy("list", "block").agg(F.max("_r").alias("_size"), F.max("_m").alias("_most"))
    over = Window.partitionBy("list").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_o", F.coalesce(F.sum("_size").over(over), F.lit(0)))
    blocks = blocks.withColumn("_v", F.max(F.col("_most") - F.col("_o")).over(over)).filter("_o > 0").select("list", "block", "_o", "_v")
    place = F.coalesce(F.col("_o") + F.col("_r") + F.greatest(F.col("_v"), F.col("_m") - F.col("_o")), F.col("_r") + F.col("_m"))
    rows = rows.join(blocks, ["list", "block"], "left").withColumn("_p", place).withColumn("_up", F.col("_p") > F.col("pos"))
    seeks = F.col("_up") & (F.col("_p") <= F.col("last"))
    rows = rows.select("row_idx", "list", "last", "block", F.col("_p").alias("pos"), F.when(~F.col("_up"), F.col("key")).alias("key"), F.when(~F.col("_up"), F.col("pref")).alias("pref"), (F.when(F.col("_up"), seeks).otherwise(F.col("moved"))).alias("moved"))
    return state.filter("pos = 0").unionByName(rows)


def assign_in_phases(*phases: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """assign_unique phase by phase: later phases serve rows that got nothing, from keys that nobody took. Adds phase, from 1."""
    done = None
    for n, wishes in enumerate(phases, 1):
        if done is not None:
            wishes = wishes.join(done.select("row_idx"), "row_idx", "left_anti")
            used = done.select("key") if taken is None else done.select("key").unionByName(taken.select("key"))
        else:
            used = taken
        got = materialize(assign_unique(wishes, used).withColumn("phase", F.lit(n)), "assigned")
        done = got if done is None else materialize(done.unionByName(got), "assigned")
    return done


def first_in_visits(visits: DataFrame, count: int) -> DataFrame:
    """The first `count` visits that get a key nobody had before; a truncated run is a prefix of a longer one."""
    return assign_unique(visits).orderBy("row_idx").limit(count)


def plan_allocation(supply: dict[tuple[int, int], int], demand: list[tuple[str, tuple[int, int], int]]) -> list[tuple[str, int, int, int, int]]:
    """Take each demand (split, bin, count) in turn from the nearest bins that have rows left.

    Bins are few (21 by 11), so this runs on counts alone. Distance is twice the first difference plus
    the second; of equally near bins the one that comes first in supply. Returns (split, bin, bin, from, to)
    with ranges of row numbers within a bin.
    """
    used, plan = dict.fromkeys(supply, 0), []
    for split, target, count in demand:
        for b in sorted(supply, key=lambda c: 2 * abs(c[0] - target[0]) + abs(c[1] - target[1])):
            n = min(count, supply[b] - used[b])
            if n > 0:
                plan.append((split, b[0], b[1], used[b] + 1, used[b] + n))
                used[b] += n
                count -= n
            if not count:
                break
    return plan


def matched_negatives(negatives: DataFrame, positives: DataFrame) -> DataFrame:
    """For each split as many negatives as it has positives, from like bins, none used twice.

    negatives: id, b1, b2; positives: split, b1, b2. Adds split to the chosen negatives. Histograms come
    to the driver; rows meet the plan by their number in the bin, in hash order.
    """
    supply = {(r.b1, r.b2): r["count"] for r in negatives.groupBy("b1", "b2").count().orderBy("b1", "b2").collect()}
    demand = [(r.split, (r.b1, r.b2), r["count"]) for r in positives.groupBy("split", "b1", "b2").count().orderBy("split", "b1", "b2").collect()]
    plan = plan_allocation(supply, demand)
    table = negatives.sparkSession.createDataFrame(plan, "split string, b1 int, b2 int, low long, high long")
    # numbers within a bin by hash prefix, so that a large bin isn't one task
    h = negatives.withColumn("_h", F.xxhash64("id")).withColumn("_c", F.shiftright("_h", 54))
    sizes = h.groupBy("b1", "b2", "_c").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("b1", "b2").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("b1", "b2", "_c", before.alias("_before"))
    inner = F.row_number().over(Window.partitionBy("b1", "b2", "_c").orderBy("_h", "id"))
    numbered = h.withColumn("_i", inner).join(sizes, ["b1", "b2", "_c"]).withColumn("_i", F.col("_i") + F.col("_before"))
    return numbered.join(F.broadcast(table), ["b1", "b2"]).filter("_i BETWEEN low AND high").select("id", "b1", "b2", "split")
