"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simloom.storage import join_small, materialize, scratch

#: Words are runs of anything but these whitespace characters.
WORD = r"[^\x20\x09-\x0D]+"
#: A source's documents are ordered in ranges of about so many.
RANGE_ROWS = 512
#: Weights are counted in so many classes an octave, over so many octaves to either side of 1; what lies beyond joins the last ones.
CLASSES, OCTAVES = 8, 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def letter_share(text: Column) -> Column:
    """The default quality weight: the share of letters in the text, 0.05 at least."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", "")).cast("double")
    return F.coalesce(F.greatest(F.lit(0.05), letters / F.nullif(F.length(text), F.lit(0)).cast("double")), F.lit(0.05))


def uniform(key: Column, seed: int) -> Column:
    """A number strictly between 0 and 1 that depends on the key and the seed alone."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**52)


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Words that each source should give.

    sizes has a row per source: source, source_size. By code point, null last, sources weigh `weights`,
    repeating, of `share` times all words. No target exceeds `most` times its source's size; what is
    over goes to the other sources by weight. In order of size per weight the sources that are cut
    come first, so running sums settle all of them at once.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy(F.col("_room"), F.col("source").asc_nulls_last())
    n = len(weights)
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % n + 1).cast("int"))
    ranked = sizes.withColumn("_w", pick).withColumn("_room", F.lit(float(most)) * F.col("source_size") / F.col("_w"))
    before = F.coalesce(F.sum("source_size").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = (F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy()) - F.lit(float(most)) * before) / F.sum("_w").over(by_room.rowsBetween(0, Window.unboundedFollowing))
    leveled = ranked.withColumn("_level", level)
    open_level = F.max(F.when(F.col("_room") > F.col("_level"), F.col("_level"))).over(Window.partitionBy())
    target = F.when((F.col("_room") <= F.col("_level")) | open_level.isNull(), F.lit(float(most)) * F.col("source_size")).otherwise(open_level * F.col("_w"))
    return leveled.select("source", "source_size", target.cast("double").alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, weight: Column | None = None, seed: int = 17) -> DataFrame:
    """How many words of each document a mix of the sources takes.

    docs: doc_id, text, source; other columns are ignored. Returns a row per row of docs: doc_id,
    size, source_size, target, taken. A source gives whole epochs first: each document as often as
    its size fits the target. What is left of the target goes to documents in the order of the key
    -ln(u) / weight, smallest first (Efraimidis and Spirakis), up to the exact word; the document at
    the edge gives a part. u is a hash of doc_id and seed, so reruns agree.

    Nulls: a null text has size 0, null sources are one source, a null doc_id is hashed as ''. A weight
    that is null, not finite or not above 0 keeps a document out of the fractional part: it gives whole epochs only.
    Rows that repeat a doc_id count as documents of their own; equal keys go by doc_id, then size.
    An empty table gives no rows; sources of no words get the target 0.

    Scale: text is read once and never shuffled. A source is cut in key ranges of about RANGE_ROWS
    documents, which are even as its weights have been counted by class: a share s of documents of weight w has a part
    s * (1 - exp(-key * w)) of its keys up to a key. Sums of ranges are prefix-summed by source, and
    documents within their own range, so that no task holds a source. What was stored on the way is freed.
    """
    with scratch(docs.sparkSession) as tables:
        return tables.keep(_mixed(docs, weights, share, most, weight, seed), "mix")


def key_place(key: Column, classes: Column) -> Column:
    """The share of a source's keys up to this one, by its classes (array of share, mean): rises with the key."""
    return F.aggregate(classes, F.lit(0.0), lambda s, c: s + c["share"] * (1 - F.exp(-key * c["mean"])))


def _mixed(docs: DataFrame, weights: Sequence[float], share: float, most: float, weight: Column | None, seed: int) -> DataFrame:
    w = weight if weight is not None else letter_share(F.col("text"))
    positive = lambda q: F.when((q > 0) & (q < float("inf")), q)  # noqa: E731  NaN is above every number
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), positive(w.cast("double")).alias("_q")).withColumn("_key", -F.log(uniform(F.col("doc_id"), seed)) / F.col("_q"))
    rows = rows.withColumn("_s", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")))
    rows = materialize(rows, "mix-rows")
    octave = F.greatest(F.lit(-OCTAVES), F.least(F.lit(OCTAVES), F.log2("_q")))
    counted = rows.groupBy("_s", "source", F.floor(octave * CLASSES).alias("_class")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.count("_q").alias("keys"), F.avg("_q").alias("mean"))
    counted = materialize(counted, "mix-classes")
    kept = F.filter(F.collect_list(F.struct("keys", "mean")), lambda c: c["keys"] > 0)
    sizes = counted.groupBy("_s", "source").agg(F.sum("size").alias("source_size"), F.sum("keys").alias("_n"), kept.alias("_kept"))
    shares = F.transform("_kept", lambda c: F.struct((c["keys"] / F.col("_n")).alias("share"), c["mean"].alias("mean")))
    sizes = materialize(sizes.withColumn("_classes", shares).drop("_kept"), "mix-sizes")
    plan = source_targets(sizes.select("source", "source_size"), weights, share, most)
    plan = plan.withColumn("_s", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))).drop("source", "source_size")
    epochs = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("long")
    plan = sizes.drop("source").join(plan, "_s").withColumn("_epochs", epochs)
    plan = plan.withColumn("_rest", F.round(F.col("target") - F.col("_epochs") * F.col("source_size")).cast("long"))
    plan = materialize(plan.withColumn("_ranges", F.ceil(F.col("_n") / RANGE_ROWS).cast("long")), "mix-plan")

    at = F.floor(F.col("_ranges") * key_place(F.col("_key"), F.col("_classes")))
    every = join_small(rows.drop("source"), plan, "_s")
    whole = every.filter("_key IS NULL").withColumn("taken", (F.col("_epochs") * F.col("size")).cast("long"))
    placed = every.filter("_key IS NOT NULL").withColumn("_range", F.least(at, F.col("_ranges") - 1))
    ranges = placed.groupBy("_s", "_range").agg(F.sum("size").alias("_words"))
    running = F.sum("_words").over(Window.partitionBy("_s").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select("_s", "_range", F.coalesce(running, F.lit(0)).alias("_before"))
    inner = Window.partitionBy("_s", "_range").orderBy("_key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_within", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(ranges, ["_s", "_range"])
    left = F.col("_rest") - F.col("_before") - F.col("_within")
    taken = F.col("_epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    return placed.withColumn("taken", taken.cast("long")).select(*columns).unionByName(whole.select(*columns))
