"""Inputs of the catalog's queries, from whole tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.storage import materialize, table

TOKENS_SQL = "tokens AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{4,14}')) AS name FROM documents)"
SPOOF_SQL = """CASE WHEN contains(name, 'm') THEN replace(name, 'm', 'rn') WHEN contains(name, 'w') THEN replace(name, 'w', 'vv')
    WHEN contains(name, 'd') THEN replace(name, 'd', 'cl') WHEN contains(name, 'o') THEN replace(name, 'o', '0')
    ELSE substr(name, 1, 2) || substr(name, 4, 1) || substr(name, 3, 1) || substr(name, 5) END"""
PAIRS_SQL = f"""{TOKENS_SQL}, pairs AS (SELECT {SPOOF_SQL} AS fraudulent_name, name AS real_name, 1.0::DOUBLE AS label FROM tokens
    UNION ALL SELECT reverse(name), name, 0.0::DOUBLE FROM tokens)"""
SCORED_SQL = "scored AS (SELECT (d.n_chars % 997) / 997.0::DOUBLE AS score, l.toxic AS label, d.source, d.lang, d.doc_id FROM documents d JOIN labels l USING (doc_id))"


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name: distinct runs of 4 to 14 ASCII letters in the documents."""
    found = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,14}"), F.lit(0))
    return table(spark, sf_dir, "documents").select(F.explode(found).alias("name")).distinct()


def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, key, row_idx: the tokens in an order of their hashes, stored."""
    return materialize(tokens(spark, sf_dir).select("name", F.col("name").alias("key"), F.conv(F.substring(F.md5("name"), 1, 15), 16, 10).cast("long").alias("row_idx")), "token-rows")


def spoof(name: Column) -> Column:
    """One fixed ASCII edit of a name."""
    out = F.concat(F.substring(name, 1, 2), F.substring(name, 4, 1), F.substring(name, 3, 1), F.substring(name, 5, 100))
    for old, new in (("o", "0"), ("d", "cl"), ("w", "vv"), ("m", "rn")):
        out = F.when(F.contains(name, F.lit(old)), F.replace(name, F.lit(old), F.lit(new))).otherwise(out)
    return out


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each token with an edited (label 1) and a reversed (label 0) one. One scan gives both."""
    both = F.array(F.struct(spoof(F.col("name")).alias("fraudulent_name"), F.col("name").alias("real_name"), F.lit(1.0).alias("label")), F.struct(F.reverse("name").alias("fraudulent_name"), F.col("name").alias("real_name"), F.lit(0.0).alias("label")))
    return tokens(spark, sf_dir).select(F.explode(both).alias("p")).select("p.*")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return docs.join(labels, "doc_id").select(((F.col("n_chars") % 997) / F.lit(997.0)).alias("score"), F.col("toxic").alias("label"), "source", "lang", "doc_id")


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer")
