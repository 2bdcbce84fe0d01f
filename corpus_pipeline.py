"""From raw documents to a training mix: STAGES, each on what the one before it kept.

Every stage takes documents with doc_id (integral), text, lang, source, n_chars and any other
columns, of whatever names, and all but the last return the same columns. In each of them:
a null text is an empty one, and stays, as do texts without words, unless the stage says otherwise; a
null doc_id is a document without a name; other columns may be null and are only carried; a text of
any length is read whole; ties go to the least doc_id, nulls last; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.llm import decontaminate, jaccard_join, line_dedup, mixing, toxicity
from simloom.storage import scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below 0.3, by a model fitted on the labelled documents among them.

    Texts without words stay whatever the labels' prior is. Rows that repeat are judged alike.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    told = toxicity.score(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all"), "text"), model, keep=["_all"])
    return told.filter((F.col("toxicity") < 0.3) | ~F.coalesce(F.col("_all.text").rlike(line_dedup.WORD), F.lit(False))).select(*[F.col(f"_all.`{c}`") for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs of 50 words or more; n_chars follows where lines went.

    A document of which no word is left goes; so does all but one of rows that repeat doc_id and text.
    """
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_all")
    done = line_dedup.dedup_lines(docs.select("doc_id", "text", others), min_words=50)
    left = done.filter((F.col("n_deleted") == 0) | F.col("text").rlike(line_dedup.WORD))
    n_chars = F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("_all.n_chars")).alias("n_chars")
    return left.select(*[n_chars if c == "n_chars" else F.col("text") if c == "text" else F.col(f"_all.`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of word 5-gram Jaccard similarity 0.8 or more: that of the least doc_id.

    Of rows that repeat doc_id and text one stays.
    """
    return jaccard_join.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark items. Rows that repeat are judged alike."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document that is left; rows that repeat are documents of their own."""
    return mixing.mix(docs, weights=(5, 2, 1), share=1.5, most=2.0)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix),
]

#: The toxicity model can't be expressed in SQL, so neither can run()'s rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents. A stage's tables go when its result is stored, and that when the next one's is."""
    docs = table(spark, sf_dir, "documents")
    with scratch(spark) as whole:
        for name, stage in STAGES[:-1]:
            with scratch(spark) as one:
                docs = one.keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
            whole.free_but_last()
        return whole.keep(STAGES[-1][1](spark, docs, sf_dir), "pipeline")
