"""A random forest on text features of pairs, balanced by class weights."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.functions import distance
from simloom.operators.sampling import holdout

FEATURES = ["levenshtein", "token_set", "positionwise", "length_delta", "shared_characters"]


def features(pairs: DataFrame) -> DataFrame:
    """pairs with one column for each of FEATURES."""
    a, b = F.coalesce("real_name", F.lit("")), F.coalesce("fraudulent_name", F.lit(""))
    cols = {"levenshtein": F.levenshtein(a, b).cast("double"), "token_set": distance.token_set_similarity(a, b), "positionwise": distance.positionwise(a, b), "length_delta": distance.length_delta(a, b).cast("double"), "shared_characters": distance.shared_characters(a, b)}
    return pairs.withColumns(cols)


def balanced(df: DataFrame) -> DataFrame:
    """df with weight: each label weighs the same in all."""
    n = df.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    total = n.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    return df.join(F.broadcast(n.join(F.broadcast(total)).select("label", (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("weight"))), "label")


def train(pairs: DataFrame, trees: int = 100, depth: int = 10, seed: int = 42) -> RandomForestClassificationModel:
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(balanced(features(pairs)))
    return RandomForestClassifier(labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed).fit(rows)


def predict(model: RandomForestClassificationModel, pairs: DataFrame) -> DataFrame:
    """pairs with score, the share of the forest for label 1."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features(pairs))
    return model.transform(rows).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def held_out_scores(pairs: DataFrame, key: str, share: float = 0.1, trees: int = 100, seed: int = 42) -> DataFrame:
    """Scores of a stratified holdout by a forest trained on the rest."""
    rows = holdout(pairs, "label", key, share, seed)
    return predict(train(rows.filter("NOT held_out"), trees=trees, seed=seed), rows.filter("held_out"))
