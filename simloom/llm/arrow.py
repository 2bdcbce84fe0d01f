"""Small helpers for the operators that work on Arrow batches."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: On text.lower() as bytes: runs of digits, letters and whatever isn't ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Rows and bytes of an Arrow batch where the session leaves Spark's defaults: texts are long, and workers small.
BATCH_ROWS, BATCH_BYTES = 500, 4 * 2**20


def small_batches(spark: SparkSession) -> None:
    """Keep batches of whole texts small, unless the session has settings of its own.

    The settings stay, as results are planned when they are asked for, after the operator returns.
    """
    for key, default, value in (("maxRecordsPerBatch", 10_000, BATCH_ROWS), ("maxBytesPerBatch", 64 * 2**20, BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if int(spark.conf.get(key).rstrip("bB")) == default:
            spark.conf.set(key, value)


def words(text: bytes | None) -> list[bytes]:
    """The words of a text in UTF-8, with A-Z in lower case (bytes.lower changes nothing else)."""
    return WORD.findall(text.lower()) if text else []


def utf8(column: str = "text") -> Column:
    return F.col(column).cast("string").cast("binary").alias(column)


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo folds; a null key counts as ''."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def sample_by_hash(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """At most `rows` rows, always the same: those of the smallest hash."""
    return df.orderBy(F.xxhash64(key.cast("string")), key).limit(rows)
