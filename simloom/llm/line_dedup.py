"""Line dedup: repeated line runs from a suffix array by distributed prefix doubling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simloom.llm.sketch import KEY, Sieve, document_key, packed, repeated_keys, repeated_rows
from simloom.storage import materialize, scratch

#: Words that a repeated run has at least.
MIN_WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\r\x0b\x0c"
#: What a line with words has from its first word on.
FULL_LINE = r"[^\x20\x09-\x0D][^\n]*"


def _joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Join by sorted shuffles at every size."""
    return left.join(right.hint("merge"), on)


def _lines(docs: DataFrame) -> DataFrame:
    """The lines that have words: document, number among these, line ID (two hashes of the trimmed line), words."""
    line = F.btrim(F.col("_l"), F.lit(SPACE))
    rows = document_key(docs.select("doc_id", "text")).filter("text IS NOT NULL")
    full = F.filter(F.split(F.col("text"), "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    rows = rows.select(*KEY, F.posexplode(full).alias("i", "_l"))
    return rows.select(*KEY, "i", F.xxhash64(line).alias("_a"), F.xxhash64(F.lit("line"), line).alias("_b"), F.regexp_count("_l", F.lit(WORD)).cast("int").alias("words"))


def _ranked(distinct: DataFrame, by: list[str]) -> DataFrame:
    """Numbers that follow the order of `by`: range partitions, sorted, numbered as they stand. To be used once."""
    return distinct.orderBy(*by).withColumn("rank", F.monotonically_increasing_id())


def _spans(rows: DataFrame, least: int) -> DataFrame:
    """Shortest runs of repeated lines of at least `least` words from each line on, and up to each line: i, m (lines).

    Any repeated run of `least` words or more is the union of such spans, and each of these repeats
    with it; so two runs are alike just where their spans are.
    """
    island = rows.withColumn("_g", F.col("i") - F.row_number().over(Window.partitionBy(*KEY).orderBy("i")))
    group = Window.partitionBy(*KEY, "_g")
    upto = island.withColumn("_w", F.sum("words").over(group.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    upto = upto.withColumn("_v", F.col("_w") - F.col("words")).withColumn("_end", F.max("i").over(group)).withColumn("_all", F.max("_w").over(group)).withColumn("_begin", F.min("i").over(group))
    after = F.min("i").over(group.orderBy(F.col("_v").desc()).rangeBetween(Window.unboundedPreceding, -least))
    before = F.max("i").over(group.orderBy(F.col("_w")).rangeBetween(Window.unboundedPreceding, -least))
    both = upto.select(
        *KEY,
        "i",
        F.coalesce(after, F.when(F.col("_all") - F.col("_v") >= least, F.col("_end") + 1)).alias("_next"),
        F.coalesce(before + 1, F.when(F.col("_w") >= least, F.col("_begin"))).alias("_from"),
    )
    ends = F.array(F.struct(F.col("i").alias("i"), (F.col("_next") - F.col("i")).alias("m")), F.struct(F.col("_from").alias("i"), (F.col("i") - F.col("_from") + 1).alias("m")))
    return both.select(*KEY, F.explode(ends).alias("s")).select(*KEY, F.col("s.i").cast("int").alias("i"), F.col("s.m").cast("int").alias("m")).filter("i IS NOT NULL AND m IS NOT NULL").distinct()


def _united(rows: DataFrame, by: list[str]) -> DataFrame:
    """Overlapping and touching stretches [i, j) of the same `by` as one; all within a document."""
    order = Window.partitionBy(*by).orderBy("i", "j")
    upto = F.max("j").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.when(upto >= F.col("i"), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(order))
    return rows.groupBy(*by, "_run").agg(F.min("i").alias("i"), F.max("j").alias("j")).drop("_run")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Later copies of repeated line runs: document key, lines from i to j (exclusive), and the earliest copy (_d0, _h0, i0).

    The suffix array of the documents' line IDs is built to the depth that min_words needs: ranks of
    1, 2, 4 ... lines, each from pairs of the ranks before, numbered by a distributed sort of the
    distinct pairs. Suffixes whose rank occurs once leave at once. An interval of the array with a
    common prefix of m lines is the set of suffixes of the same two overlapping ranks of the largest
    power of two in m; its least member (by doc_id, then text hash, then line) is kept. A run longer
    than that is a chain of intervals: those of one document and one earliest copy at the same
    distance are united, so what is returned is maximal against that copy.

    Rows that repeat a key have the same lines, of which each counts once.

    Scale: what is shuffled are numbers of repeated lines. Hot IDs and pairs are counted with partial
    sums; only distinct ones are sorted; joins back to occurrences can be split by Spark. Joins are
    of the same kind at every size. Own tables go when the runs are stored.
    """
    with scratch(docs.sparkSession) as block:
        return block.keep(_later_copies(docs, min_words), "lines-runs")


def _later_copies(docs: DataFrame, min_words: int) -> DataFrame:
    lines = materialize(_lines(docs), "lines")
    often = lines.groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_a", "_b")
    ids = _ranked(often, ["_a", "_b"])
    level = _joined(lines, ids, ["_a", "_b"]).select(*KEY, "i", "words", "rank")
    level = materialize(level.dropDuplicates([*KEY, "i"]), "lines-level")
    spans = materialize(_spans(level, min_words), "lines-spans")
    deepest = spans.agg(F.coalesce(F.max("m"), F.lit(0))).first()[0]
    levels, k = [level.select(*KEY, "i", F.lit(0).alias("k"), "rank")], 0
    order = Window.partitionBy(*KEY).orderBy("i")
    while 2 ** (k + 1) <= deepest:
        step = 2**k
        if k:  # suffixes that left earlier make holes, so that lead() would miss
            other = levels[-1].select(*KEY, (F.col("i") - step).alias("i"), F.col("rank").alias("_r2"))
            pairs = _joined(levels[-1], other, [*KEY, "i"])
        else:
            pairs = levels[-1].withColumn("_r2", F.lead("rank", step).over(order)).withColumn("_i2", F.lead("i", step).over(order)).filter(F.col("_i2") == F.col("i") + step)
        pairs = pairs.select(*KEY, "i", F.col("rank").alias("_r1"), "_r2")
        names = _ranked(pairs.groupBy("_r1", "_r2").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_r1", "_r2"), ["_r1", "_r2"])
        k += 1
        level = materialize(_joined(pairs, names, ["_r1", "_r2"]).select(*KEY, "i", F.lit(k).alias("k"), "rank"), "lines-level")
        if not level.limit(1).count():
            break
        levels.append(level)
    known = levels[0]
    for x in levels[1:]:
        known = known.unionByName(x)
    deep = F.floor(F.log2(F.col("m").cast("double") + 0.5)).cast("int")
    told = spans.withColumn("k", deep).withColumn("_i2", (F.col("i") + F.col("m") - F.pow(F.lit(2), F.col("k"))).cast("int"))
    told = _joined(told, known.withColumnRenamed("rank", "_r1"), [*KEY, "k", "i"])
    told = _joined(told, known.withColumnRenamed("rank", "_r2").withColumnRenamed("i", "_i2"), [*KEY, "k", "_i2"])
    told = materialize(told.select(*KEY, "i", "m", "_r1", "_r2"), "lines-intervals")
    firsts = told.groupBy("m", "_r1", "_r2").agg(F.min(F.struct(*KEY, "i")).alias("_0"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    # stored, so that the join isn't bound to the aggregation's partitions and Spark can split a hot interval
    firsts = materialize(firsts, "lines-firsts")
    later = _joined(told, firsts, ["m", "_r1", "_r2"]).filter(F.struct(*KEY, "i") != F.col("_0"))
    own = (F.col("_d") == F.col("_0._d")) & (F.col("_h") == F.col("_0._h"))
    begin = F.when(own, F.greatest(F.col("i"), F.col("_0.i") + F.col("m"))).otherwise(F.col("i"))
    later = later.select(*KEY, F.col("_0._d").alias("_d0"), F.col("_0._h").alias("_h0"), (F.col("i") - F.col("_0.i")).alias("_apart"), begin.cast("int").alias("i"), (F.col("i") + F.col("m")).cast("int").alias("j"))
    runs = _united(later.filter("i < j").repartition(*KEY), [*KEY, "_d0", "_h0", "_apart"])
    return runs.select(*KEY, "i", "j", "_d0", "_h0", (F.col("i") - F.col("_apart")).cast("int").alias("i0"))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _without_runs(text: Column, runs: Column) -> Column:
    """text without the lines of runs: disjoint [i, j) in order, over the lines that have words.

    A line without words goes if it lies within a run. What is kept are the slices between runs, so
    the work is linear in lines and runs.
    """

    def cut(lines: Column) -> Column:
        full = F.filter(F.transform(lines, lambda x, i: F.when(F.btrim(x, F.lit(SPACE)) != "", i)), lambda i: i.isNotNull())

        def kept(at: Column) -> Column:
            gone = F.transform(runs, lambda r: F.struct(F.get(at, r["i"]).alias("a"), (F.get(at, r["j"] - 1) + 1).alias("b")))
            return _let(gone, lambda g: F.flatten(F.transform(F.sequence(F.lit(0), F.size(g)), lambda k: _between(lines, g, k))))

        return _let(full, kept)

    def _between(lines: Column, gone: Column, k: Column) -> Column:
        begin = F.when(k == 0, F.lit(0)).otherwise(F.get(gone, k - 1)["b"])
        end = F.when(k == F.size(gone), F.size(lines)).otherwise(F.get(gone, k)["a"])
        return F.slice(lines, begin + 1, end - begin)

    return F.array_join(_let(F.split(text, "\n"), cut), "\n")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs without later copies of line runs of at least min_words words that occur elsewhere.

    docs: doc_id (integral), text and any other columns. Lines are cut at \\n and compared without whitespace
    around them; lines without words are passed over, and go if they lie within a deleted run. The
    earliest copy by doc_id (nulls last), text hash and line stays. Returns a row per row of docs:
    its columns, with the text that is left, and n_lines (lines with words), n_deleted (of these),
    copy_of (the doc_ids of the copies that stay); columns of these names in docs are replaced.

    Rows that repeat doc_id and text are copies of each other: one stays (see repeated_rows), and the
    others lose all lines if they have min_words words. Null and empty texts stay as they are. A
    text of any length is one row's work. An empty table gives no rows.

    Scale: see repeated_runs. Only documents with runs, and rows that repeat, are shuffled to meet
    what is known of them; texts are never sorted. All of it is DataFrame functions.
    """
    with scratch(docs.sparkSession) as block:
        found = _later_copies(docs, min_words).repartition(*KEY)
        sources = found.groupBy(*KEY).agg(F.array_sort(F.collect_set(F.when(F.col("_d0") < 2**63 - 1, F.col("_d0")))).alias("copy_of"))
        runs = _united(found.select(*KEY, "i", "j"), KEY).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("i", "j"))).alias("_runs"))
        rows = packed(docs, "text")
        many = repeated_keys(document_key(docs.select("doc_id", "text")))
        told = runs.join(sources.hint("merge"), KEY).join(many.withColumn("_many", F.lit(True)).hint("merge"), KEY, "full")
        told = block.keep(told, "lines-told")
        many = block.keep(many, "repeated-keys")
    sieve = Sieve(told)
    single = sieve.met(rows, "left").filter("_many IS NULL").drop("_many").withColumn("_first", F.lit(True))
    again = repeated_rows(rows, many).join(told.drop("_many").hint("shuffle_hash"), KEY, "left")
    n_lines = F.coalesce(F.regexp_count("text", F.lit(FULL_LINE)), F.lit(0)).cast("int")
    none = F.array().cast("array<bigint>")
    clean = sieve.out(rows).select("_row", "text", n_lines.alias("n_lines"), F.lit(0).alias("n_deleted"), none.alias("copy_of"))
    emptied = ~F.col("_first") & F.coalesce(F.regexp_count("text", F.lit(WORD)) >= min_words, F.lit(False))
    moved = single.unionByName(again.select(single.columns), allowMissingColumns=True).withColumn("n_lines", n_lines).withColumn("_emptied", emptied)
    gone = F.coalesce(F.aggregate("_runs", F.lit(0), lambda a, r: a + r["j"] - r["i"]), F.lit(0))
    moved = moved.select(
        "_row",
        F.when(F.col("_emptied"), F.lit("")).when(F.col("_runs").isNotNull(), _without_runs(F.col("text"), F.col("_runs"))).otherwise(F.col("text")).alias("text"),
        "n_lines",
        F.when(F.col("_emptied"), F.col("n_lines")).otherwise(gone).alias("n_deleted"),
        F.coalesce("copy_of", none).alias("copy_of"),
    )
    kept = [c for c in docs.columns if c not in ("n_lines", "n_deleted", "copy_of")]
    columns = [F.col("text") if c == "text" else F.col(f"_row.`{c}`") for c in kept]
    return clean.unionByName(moved).select(*columns, "n_lines", "n_deleted", "copy_of")
