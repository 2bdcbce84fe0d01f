"""Runs of experiments: configurations and logs of changing fields, as VARIANT columns, and a row for each run."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fields of a run's row: name: path in its configuration, type, value where the configuration has none.
Fields = dict[str, tuple[str, str, object]]

# What a run's row shows of its configuration.
RUN_FIELDS: Fields = {"pooling": ("$.model.pooling", "string", "unknown"), "remove_padding": ("$.slicing.remove_padding", "boolean", False), "background": ("$.rendering.background", "string", "unknown"), "slice_width": ("$.slicing.slice_width", "double", None), "stride": ("$.slicing.stride", "double", None)}


@F.pandas_udf(T.StringType())
def _as_json(texts: pd.Series) -> pd.Series:
    """Configurations in YAML (JSON is YAML too); what can't be read is null."""
    try:
        import yaml

        read, errors = yaml.safe_load, (yaml.YAMLError, ValueError)
    except ImportError:
        read, errors = json.loads, (ValueError,)

    def one(text: str | None) -> str | None:
        try:
            value = read(text) if text else None
        except errors:
            return None
        return json.dumps(value, default=str) if isinstance(value, dict) else None

    return texts.map(one)


def _run(path: Column) -> Column:
    """The folder that a file is in."""
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -2)


def run_configs(spark: SparkSession, pattern: str) -> DataFrame:
    """run, config (VARIANT): a configuration file for each run's folder, in YAML or JSON."""
    texts = spark.read.text(pattern, wholetext=True).select(_run(F.col("_metadata.file_path")).alias("run"), _as_json("value").alias("json"))
    return texts.select("run", F.try_parse_json("json").alias("config")).filter("config IS NOT NULL")


def run_logs(spark: SparkSession, pattern: str) -> DataFrame:
    """run, line (from 1), row (VARIANT): lines of CSV logs by their own headers, whatever columns a log has; numbers are numbers, empty cells missing.

    A log is read as one row, as it has a line for an epoch; cells hold no quoted commas.
    """
    logs = spark.read.text(pattern, wholetext=True).select(_run(F.col("_metadata.file_path")).alias("run"), F.split(F.regexp_replace("value", "\r", ""), "\n").alias("lines"))
    rows = logs.select("run", F.transform(F.split(F.get("lines", F.lit(0)), ","), lambda c: F.trim(c)).alias("names"), F.posexplode(F.slice("lines", 2, 2**31 - 1)).alias("line", "text")).filter(F.trim("text") != "")
    cells = F.transform(F.split("text", ","), lambda c: F.trim(c))
    pairs = F.filter(F.arrays_zip(F.col("names").alias("k"), cells.alias("v")), lambda c: c["k"].isNotNull() & (c["k"] != "") & (F.coalesce(c["v"], F.lit("")) != ""))
    # a JSON object by hand, as values of a map have one type
    value = lambda c: F.when(c["v"].rlike(r"^-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?$"), c["v"]).otherwise(F.to_json(F.array(c["v"])).substr(F.lit(2), F.length(F.to_json(F.array(c["v"]))) - 2))
    key = lambda c: F.to_json(F.array(c["k"])).substr(F.lit(2), F.length(F.to_json(F.array(c["k"]))) - 2)
    text = F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda c: F.concat(key(c), F.lit(":"), value(c))), ","), F.lit("}"))
    return rows.select("run", (F.col("line") + 1).cast("long").alias("line"), F.try_parse_json(text).alias("row"))


def summarized(configs: DataFrame, logs: DataFrame, fields: Fields, metric: str = "val_auc", order: str = "epoch") -> DataFrame:
    """A row for each run that has both: run, n_rows, best (of the metric), best_at (the least order where it stands), and the fields.

    configs: run, config; logs: run, row (both VARIANT). Rows without the metric, or where it isn't a number, count in n_rows
    alone; a run without any has a null best. A configuration's field that is missing or of another type gets its default.
    """
    m = F.try_variant_get("row", f"$.{metric}", "double")
    at = F.try_variant_get("row", f"$.{order}", "long")
    m = F.when(~F.isnan(m), m)
    told = logs.select("run", m.alias("_m"), at.alias("_at"))
    best = told.groupBy("run").agg(F.count(F.lit(1)).alias("n_rows"), F.max("_m").alias("best"), F.min_by("_at", F.when(F.col("_m").isNotNull(), F.struct((-F.col("_m")).alias("a"), F.col("_at").alias("b")))).alias("best_at"))
    shown = [F.coalesce(F.try_variant_get("config", path, kind), F.lit(default).cast(kind)).alias(name) for name, (path, kind, default) in fields.items()]
    return configs.select("run", *shown).join(best, "run").select("run", "n_rows", "best", "best_at", *fields)


def run_table(spark: SparkSession, folders: str, fields: Fields | None = None, config: str = "config.yaml", log: str = "log.csv", metric: str = "val_auc") -> DataFrame:
    """summarized over the folders of a glob, with overlap_type where fields have slice_width and stride."""
    fields = fields or RUN_FIELDS
    out = summarized(run_configs(spark, f"{folders}/{config}"), run_logs(spark, f"{folders}/{log}"), fields, metric)
    if {"slice_width", "stride"} <= fields.keys():
        out = out.withColumn("overlap_type", F.when(F.col("stride") < F.col("slice_width"), "overlapping").otherwise("non-overlapping"))
    return out


def varying_fields(configs: DataFrame) -> DataFrame:
    """One row, schema: all fields that configurations have, with the types that hold all of their values."""
    return configs.agg(F.schema_of_variant_agg("config").alias("schema"))
