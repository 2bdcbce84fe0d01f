"""Sinks: tables, appended logs, manifests and reports."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.storage import swap_in


def parquet(df: DataFrame, path: str, by: Iterable[str] = (), replace: bool = True) -> None:
    df.write.mode("overwrite" if replace else "errorifexists").partitionBy(*by).parquet(path)


def csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").csv(path, header=True, sep=sep)


def append(df: DataFrame, path: str) -> None:
    """Rows are added; files have their own headers, so there is nothing to write once."""
    df.write.mode("append").csv(path, header=True)


def predictions(df: DataFrame, path: str) -> None:
    """label, score and the prediction at 0.5."""
    df.select(F.col("label").cast("int").alias("label"), "score", (F.col("score") >= 0.5).cast("int").alias("prediction_0_5")).write.mode("overwrite").parquet(path)


def split_files(df: DataFrame, path: str, split: str = "split") -> None:
    """Pairs by split as CSV, without nulls."""
    out = df.select(split, F.coalesce("fraudulent_name", F.lit("")).alias("fraudulent_name"), F.coalesce("real_name", F.lit("")).alias("real_name"), F.col("label").cast("double").alias("label"))
    out.write.mode("overwrite").partitionBy(split).csv(path, header=True)


def _plain(v):
    return v.item() if hasattr(v, "item") else v.tolist() if hasattr(v, "tolist") else str(v)


def manifest(spark: SparkSession, path: str, values: dict) -> None:
    """A JSON document; arrays, paths and numpy values become plain ones."""
    text(spark, path, json.dumps(values, indent=2, sort_keys=True, default=_plain))


def text(spark: SparkSession, path: str, content: str) -> None:
    """One text file on any file system that Spark reaches; it replaces what was there by renames (see swap_in)."""
    staged = spark._jvm.org.apache.hadoop.fs.Path(path + ".next")
    out = staged.getFileSystem(spark._jsc.hadoopConfiguration()).create(staged, True)
    out.write(bytearray(content.encode()))
    out.close()
    swap_in(spark, path + ".next", path)


def markdown_table(df: DataFrame, most: int = 100) -> str:
    """A report table of at most `most` rows."""
    rows = df.limit(most).collect()
    line = lambda cells: "| " + " | ".join("" if c is None else f"{c:.4f}" if isinstance(c, float) else str(c).replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *[line(r) for r in rows]])


def config(spark: SparkSession, path: str, values: dict) -> None:
    """A copy of a run's configuration, keys in their order, as YAML that is JSON as well."""
    text(spark, path, json.dumps(values, indent=2, default=_plain))


def console_table(df: DataFrame, most: int = 100) -> str:
    """At most `most` rows for a console: numbers to the right with four places, all else to the left."""
    rows = df.limit(most).collect()
    shown = lambda c: "-" if c is None else f"{c:,.4f}" if isinstance(c, float) else f"{c:,}" if isinstance(c, int) and not isinstance(c, bool) else str(c)
    cells = [df.columns, *[[shown(c) for c in r] for r in rows]]
    right = [t in ("double", "float", "int", "bigint", "smallint", "tinyint") for _, t in df.dtypes]
    wide = [max(len(r[k]) for r in cells) for k in range(len(df.columns))]
    line = lambda r: "  ".join(c.rjust(w) if num else c.ljust(w) for c, w, num in zip(r, wide, right, strict=True)).rstrip()
    return "\n".join([line(cells[0]), "  ".join("-" * w for w in wide), *[line(r) for r in cells[1:]]])


def two_sections(spark: SparkSession, path: str, first: DataFrame, second: DataFrame) -> None:
    csv(first, f"{path}/first")
    csv(second, f"{path}/second")


def review_table(df: DataFrame, path: str, defaults: dict[str, object]) -> None:
    parquet(df.withColumns({k: F.lit(v) for k, v in defaults.items() if k not in df.columns}), path)


def operations_json(df: DataFrame, column: str = "operations") -> DataFrame:
    """Operations as JSON text in column operations_json."""
    return df.withColumn("operations_json", F.to_json(column)).drop(column)
