"""Sources: typed tables, rule tables and configurations."""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simloom.functions.text import number_or
from simloom.operators.checks import cleaned_pairs, pair_violations, require_none
from simloom.operators.generators import infer_swap
from simloom.operators.ranking import first_per_key
from simloom.operators.sampling import sample_rows

# Names of splits
SPLIT_ALIASES = {"train": "train", "training": "train", "test": "test", "validation": "validation", "validate": "validation", "val": "validation"}
PAIRS = "fraudulent_name string, real_name string, label double"


def pairs(spark: SparkSession, path: str, mode: str = "strict") -> DataFrame:
    """A pair table. strict raises for bad labels and empty names; lenient leaves empty names out; negatives sets label 0."""
    df = require_columns(spark.read.parquet(path), ["fraudulent_name", "real_name", "label"])
    out = cleaned_pairs(df, drop_empty=mode == "lenient", as_negatives=mode == "negatives")
    if mode == "strict":
        require_none(pair_violations(out))
    return out


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def typed_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, sep=sep, quote='"', escape='"')


def vectors_hdf5(spark: SparkSession, path: str, key: str, values: str) -> DataFrame:
    """id and vector of two datasets of an HDF5 file. Needs h5py; convert large files to Parquet once."""
    try:
        import h5py
    except ImportError as e:
        raise RuntimeError("reading HDF5 needs h5py") from e
    with h5py.File(path) as f:
        return spark.createDataFrame(list(zip(f[key][:].tolist(), f[values][:].tolist(), strict=True)), "id long, vector array<float>")


def pickled_rows(spark: SparkSession, path: str, schema: str, split: str | None = None) -> DataFrame:
    """A list of tuples, or one of a dict of splits, from a pickle file that you trust."""
    with open(path, "rb") as f:
        rows = pickle.load(f)
    return spark.createDataFrame([tuple(r) for r in (rows[split] if split else rows)], schema)


def csv_or_derived(spark: SparkSession, path: str, schema: str, derive) -> DataFrame:
    """The CSV at path; where there is none, what derive() gives is written there first."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        derive().write.csv(path, header=True)
    return typed_csv(spark, path, schema)


@F.pandas_udf(T.StringType())
def decoded_codepoint(x):
    """U+0061 or a plain text."""
    return x.map(lambda s: chr(int(s[2:], 16)) if s and s[:2].upper() == "U+" else s)


def json_list(spark: SparkSession, path: str, schema: str, codepoints: Iterable[str] = ()) -> DataFrame:
    df = spark.read.schema(schema).json(path, multiLine=True)
    return df.withColumns({c: decoded_codepoint(F.col(c)) for c in codepoints})


def yaml_config(path: str) -> dict:
    """A configuration file; JSON where PyYAML is missing."""
    with open(path) as f:
        text = f.read()
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


def config_run_name(config: dict) -> str:
    """The configuration's run_name; where it has none, the time of day in UTC."""
    return str(config.get("run_name") or datetime.now(UTC).strftime("%Y%m%dT%H%M%SZ"))


def split_name(name: str) -> str:
    if name not in SPLIT_ALIASES:
        raise ValueError(f"unknown split {name!r}")
    return SPLIT_ALIASES[name]


def with_aliases(df: DataFrame, aliases: dict[str, list[str]], defaults: dict[str, object] | None = None) -> DataFrame:
    """Columns by their first name that exists; others are null or a default."""
    out = {}
    for name, others in aliases.items():
        got = next((c for c in (name, *others) if c in df.columns), None)
        out[name] = F.col(got) if got else F.lit((defaults or {}).get(name))
    return df.select(*[c.alias(n) for n, c in out.items()], *[c for c in df.columns if c not in out and not any(c in o for o in aliases.values())])


def freshest(spark: SparkSession, paths: list[str]) -> str | None:
    """The path that was modified last; of equal ones the first."""
    found = []
    for k, p in enumerate(paths):
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(path):
            found.append((fs.getFileStatus(path).getModificationTime(), -k, p))
    return max(found)[2] if found else None


def is_fresh(spark: SparkSession, output: str, inputs: list[str]) -> bool:
    return freshest(spark, [output, *inputs]) == output


def rules(df: DataFrame, score: Column, family: str, width: int | None = 1) -> DataFrame:
    """Valid rules: source and replacement of `width` characters (any, but not none, for None), unequal; the best score of each.

    Returns source, replacement, score, operation, family.
    """
    ok = (F.col("source") != F.col("replacement")) & (F.col("source") != "") & (F.col("replacement") != "")
    if width:
        ok = ok & (F.length("source") == width) & (F.length("replacement") == width)
    out = df.filter(ok).select("source", "replacement", number_or(score, F.lit(0.0)).alias("score"), F.concat("source", F.lit("_to_"), "replacement").alias("operation"), F.lit(family).alias("family"))
    return first_per_key(out, ["source", "replacement"], [-F.col("score")])


def gated_exact(df: DataFrame) -> DataFrame:
    """Look-alike rules of nearly the same shape and area; priority 0, or 1 where NFKC changes the replacement."""
    from simloom.functions.text import changed_by_nfkc

    # fixed values: gates, inclusive
    ok = (F.col("glyph_similarity") >= 0.999) & F.col("area_ratio").between(0.995, 1.005)
    return df.filter(ok).withColumn("priority", changed_by_nfkc(F.col("replacement")).cast("int"))


def gated_ocr(df: DataFrame, least: float = 3.0) -> DataFrame:
    return df.filter(F.col("q25") >= least).withColumn("priority", F.lit(10))


def gated_multichar(df: DataFrame, sources: tuple[str, ...] = ("w", "m")) -> DataFrame:
    return df.filter(F.col("source").isin(*sources)).withColumn("priority", F.lit(50))


def swap_rules(df: DataFrame) -> DataFrame:
    """Swap rules (real_name, swapped_name, score), with the place of the swap where it isn't given; others go."""
    at = infer_swap(F.col("real_name"), F.col("swapped_name"))
    at = F.coalesce(F.col("swap_i"), at) if "swap_i" in df.columns else at
    return df.withColumn("swap_i", at).filter("swap_i >= 2").withColumn("swap_j", F.col("swap_i") + 1)


def unique_names(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The first name of each key: name, key, order column."""
    return first_per_key(df.select("name", order, key.alias("key")).filter("key != ''"), ["key"], [F.col(order)])


def neighbor_lists(df: DataFrame, by: str = "target") -> DataFrame:
    """Neighbours of each target in rank order, as one array."""
    return df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rank", "neighbor", "distance"))).alias("neighbors"))


def run_summaries(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """The best value of each log under a glob: file, best_val_auc."""
    logs = spark.read.schema(schema).csv(pattern, header=True).withColumn("file", F.input_file_name())
    return logs.groupBy("file").agg(F.max("val_auc").alias("best_val_auc"))


def seeded_subset(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    return sample_rows(df, n, seed, key)
