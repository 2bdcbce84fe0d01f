"""A sketch of a fixed size tells which rows may have a key, so that only those are shuffled to meet it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simloom.storage import materialize

#: Document keys: doc_id (nulls as the largest long) and a hash of the text.
KEY = ["_d", "_h"]
#: Bits of a sketch (eight megabytes), and bits of one row of its table.
SKETCH_BITS, ROW_BITS = 2**26, 2**15


def document_key(docs: DataFrame) -> DataFrame:
    """docs with _d (doc_id as a long, nulls as the largest) and _h (hash of the text): equal only in rows that repeat.

    doc_id must be of an integral type, or strings of such numbers; the largest long is kept for nulls.
    """
    return docs.withColumn("_d", F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))).withColumn("_h", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def _bit(hashed: Column, bits: int) -> tuple[Column, Column]:
    """Row and place of a hash in the table of bits."""
    at = F.pmod(hashed, F.lit(bits))
    return F.floor(at / ROW_BITS).cast("long"), (at % ROW_BITS).cast("long")


def sketch(keys: DataFrame, on: list[str], bits: int = SKETCH_BITS) -> DataFrame:
    """Which bits the keys set: a table of `bits` bits at most, however many they are."""
    row, place = _bit(F.xxhash64(*on), bits)
    return materialize(keys.select(row.alias("_sketch_row"), place.alias("_place")).groupBy("_sketch_row").agg(F.bitmap_construct_agg("_place").alias("_bits")), "sketch")


def maybe_in(rows: DataFrame, table: DataFrame, on: list[str], bits: int = SKETCH_BITS) -> DataFrame:
    """rows with _maybe: False only for keys that aren't among those of the sketch."""
    row, place = _bit(F.xxhash64(*on), bits)
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.getbit(byte, (place % 8).cast("int")) == 1
    joined = rows.withColumn("_sketch_row", row).join(F.broadcast(table), "_sketch_row", "left")
    return joined.withColumn("_maybe", F.coalesce(is_set, F.lit(False))).drop("_sketch_row", "_bits")


class Sieve:
    """Parts rows by whether their key may be among `keys` (materialized, narrow, each key once).

    At every size the same happens: a sketch is broadcast (at most SKETCH_BITS), rows that it rules
    out stay where they are, and the others are shuffled to a hash table of the keys, unsorted. Where
    keys are so many that the sketch fills up, more rows are shuffled; results don't change.
    """

    def __init__(self, keys: DataFrame, on: list[str] = KEY):
        self.keys, self.on = keys, on
        self.table = sketch(keys, on)

    def out(self, rows: DataFrame) -> DataFrame:
        """Rows whose key is surely not among the keys."""
        return maybe_in(rows, self.table, self.on).filter(~F.col("_maybe")).drop("_maybe")

    def met(self, rows: DataFrame, how: str = "inner") -> DataFrame:
        """The other rows, joined with the keys."""
        return maybe_in(rows, self.table, self.on).filter("_maybe").drop("_maybe").join(self.keys.hint("shuffle_hash"), self.on, how)

    def without(self, rows: DataFrame) -> DataFrame:
        """rows whose key isn't among the keys."""
        return self.out(rows).unionByName(self.met(rows, "left_anti").select(*rows.columns))


def repeated_keys(keyed: DataFrame) -> DataFrame:
    """The document keys of more than one row."""
    return materialize(keyed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*KEY), "repeated-keys")


def repeated_rows(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of repeated keys with _first: true for one row of each key.

    rows: KEY, _row (a struct of all columns). Of rows that differ elsewhere the first is that of the
    least hash of its JSON form, so reruns agree; of equal rows it doesn't matter which. They are stored with
    a number, so that the choice holds; a key of very many rows is met by partial minima.
    """
    moved = Sieve(keys).met(rows).withColumn("_uid", F.struct(F.xxhash64(F.to_json("_row", {"ignoreNullFields": "false"})).alias("h"), F.monotonically_increasing_id().alias("n")))
    moved = materialize(moved, "repeated-rows")
    first = materialize(moved.groupBy(*KEY).agg(F.min("_uid").alias("_least")), "repeated-first")
    return moved.join(first.hint("shuffle_hash"), KEY).withColumn("_first", F.col("_uid") == F.col("_least")).drop("_uid", "_least")


def packed(docs: DataFrame, *more: str) -> DataFrame:
    """KEY, the columns in more, and _row: all others as one struct, so that no name of theirs can clash."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in more]
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.struct(*rest).alias("_row"))
    return document_key(rows).select(*KEY, "_row", *more)


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col(f"_row.`{c}`") for c in columns])
