"""Quality: document evidence combined with host and path posteriors by hierarchical empirical Bayes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from simloom.llm.arrow import sample_by_hash, small_batches, utf8
from simloom.storage import join_small, materialize

#: Labelled documents that the document classifier is fitted on at most.
TRAIN_DOCS = 10_000
FEATURES = 12
# Byte classes: 0 letters (and all of UTF-8 beyond ASCII), 1 digits, 2 spaces, 3 newlines, 4 sentence marks, 5 other.
_CLASS = np.full(256, 5, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 0
_CLASS[48:58] = 1
_CLASS[[9, 11, 12, 13, 32]] = 2
_CLASS[10] = 3
_CLASS[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]] = 4


def features(text: bytes | None) -> list[float]:
    """Shares of characters, lengths of words and lines, and repetition, over the whole text."""
    if not text:
        return [0.0] * (FEATURES - 1) + [1.0]
    kinds = _CLASS[np.frombuffer(text, np.uint8)]
    share = np.bincount(kinds, minlength=6) / len(kinds)
    tokens = text.split()
    n = max(1, len(tokens))
    lines = text.split(b"\n")
    changes = np.count_nonzero(kinds[1:] != kinds[:-1]) / len(kinds)
    return [*share.tolist(), len(text) / n / 10, len(set(tokens)) / n, len(set(lines)) / len(lines), float(np.log1p(len(tokens))) / 10, changes, 0.0]


@dataclass
class Evidence:
    """A logistic regression on standardised features and their squares."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.column_stack([np.ones(len(z)), z, z * z - 1]) @ self.weights


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Evidence:
    """Newton's method; with one class or no rows the evidence is the smoothed prior everywhere."""
    x = x.reshape(-1, FEATURES)
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    prior = (y.sum() + 0.5) / (len(y) + 1.0)
    out = Evidence(mean, scale, np.zeros(2 * FEATURES + 1))
    out.weights[0] = np.log(prior / (1 - prior))
    if len(set(y.tolist())) < 2:
        return out
    z = np.clip((x - mean) / scale, -6, 6)
    a = np.column_stack([np.ones(len(z)), z, z * z - 1])
    penalty = np.eye(a.shape[1]) * ridge
    penalty[0, 0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ out.weights, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + penalty, a.T @ (p - y) + penalty @ out.weights)
        out.weights -= np.clip(step, -3, 3)
    return out


def _with_features(docs: DataFrame, keep: list[str]) -> DataFrame:
    small_batches(docs.sparkSession)
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("_x", T.ArrayType(T.DoubleType()))])
    arrow = to_arrow_schema(schema)

    def computed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t) for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in range(len(keep))], pa.array(x, arrow.types[-1])], schema=arrow)

    return docs.select(*keep, utf8()).mapInArrow(computed, schema)


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Evidence:
    """Fit the document classifier on at most `most` labelled documents (those of the smallest hash).

    labels: doc_id, quality; null labels aren't used, and a document labelled both ways counts as bad.
    """
    marked = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min((F.col("quality") > 0).cast("int")).alias("_y"))
    picked = sample_by_hash(marked, F.col("doc_id"), most)
    rows = _with_features(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"), ["doc_id", "_y"]).select("doc_id", "_y", "_x").toArrow()
    if not rows.num_rows:
        return fit(np.zeros((0, FEATURES)), np.zeros(0))
    order = np.argsort(np.asarray(rows.column("doc_id")), kind="stable")
    x = np.asarray(rows.column("_x").combine_chunks().flatten()).reshape(-1, FEATURES)
    return fit(x[order], np.asarray(rows.column("_y"))[order].astype(float))


def _strength(sites: DataFrame, n: str, s: str, mean: str | float) -> float:
    """How many documents a prior weighs, by moments: what sites vary beyond what chance would make them."""
    m = F.col(mean) if isinstance(mean, str) else F.lit(mean)
    gap = F.col(s) / F.col(n) - m
    got = sites.filter(F.col(n) > 0).agg(F.sum(F.col(n)).alias("n"), F.sum(F.col(n) * gap * gap).alias("v"), F.count(F.lit(1)).alias("k"), F.sum(m * (1 - m)).alias("chance"), F.sum(F.col(n) * m * (1 - m)).alias("spread")).first()
    if not got["n"] or got["k"] < 2:
        return 100.0
    between = max(0.0, got["v"] - got["chance"]) / got["n"]
    return float(min(1e4, max(1.0, (got["spread"] / got["n"]) / between - 1 if between > 0 else 1e4)))


def judge(docs: DataFrame, model: Evidence, host: Column, path: Column, bar: float = 0.5) -> DataFrame:
    """The probability that each document is good, from its text and from where it stands.

    docs: doc_id, text and what host and path need; other columns are ignored. Document evidence is
    summed up by host and path. A host's posterior is its mean, shrunk to the global mean; a path's is
    its mean shrunk to its host's posterior, both without the document itself; the prior strengths are
    estimated from how much sites vary. The document's log odds shift by how far its path's posterior
    is from the global mean. Returns a row per row of docs: doc_id, host, path, evidence (the
    classifier's probability), host_posterior, path_posterior, quality, keep (quality >= bar).

    Null hosts, and null paths of a host, are sites like others. Null and empty texts have features of
    their own. Rows that repeat are judged each. An empty table gives no rows.

    Scale: texts are read once and never shuffled. Sites come from partial sums; they are broadcast
    if few, joined if many.
    """
    rows = _with_features(docs.select("doc_id", "text", F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path")), ["doc_id", "host", "path"])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*rows.schema.fields[:3], T.StructField("_odds", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def weighed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column(3).flatten()).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in range(3)], pa.array(np.clip(shared.value.log_odds(x), -12, 12))], schema=arrow)

    rows = materialize(rows.mapInArrow(weighed, schema).withColumn("evidence", 1 / (1 + F.exp(-F.col("_odds")))), "quality-evidence")
    paths = materialize(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("_n"), F.sum("evidence").alias("_s")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("_n").alias("_hn"), F.sum("_s").alias("_hs"))
    n, s = paths.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum("_s"), F.lit(0.0))).first()
    mean = min(1 - 1e-6, max(1e-6, s / n)) if n else 0.5
    strong = _strength(hosts, "_hn", "_hs", mean)
    hosts = materialize(hosts.withColumn("host_posterior", (F.col("_hs") + strong * mean) / (F.col("_hn") + strong)), "quality-hosts")
    of_host = strong
    paths = join_small(paths, hosts, "host")
    strong = _strength(paths, "_n", "_s", "host_posterior")
    paths = materialize(paths, "quality-sites")
    # what a document is judged by comes from the others alone, at both levels
    told = join_small(rows, paths, ["host", "path"]).withColumn("host_posterior", (F.col("_hs") - F.col("evidence") + of_host * mean) / (F.col("_hn") - 1 + of_host))
    others = (F.col("_s") - F.col("evidence") + strong * F.col("host_posterior")) / (F.col("_n") - 1 + strong)
    told = told.withColumn("path_posterior", F.least(F.greatest(others, F.lit(1e-6)), F.lit(1 - 1e-6)))
    shift = F.log(F.col("path_posterior") / (1 - F.col("path_posterior"))) - float(np.log(mean / (1 - mean)))
    told = told.withColumn("quality", 1 / (1 + F.exp(-(F.col("_odds") + shift))))
    return told.select("doc_id", "host", "path", "evidence", "host_posterior", "path_posterior", "quality", (F.col("quality") >= bar).alias("keep"))
