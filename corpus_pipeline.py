"""A corpus pipeline: drop toxic and poor documents, near-duplicates and contaminated ones, then pack.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the
columns of ``docs``; the last returns packed pieces. Extra columns of documents pass through.
Every row is judged by its own text, whether its doc_id is null or shared by other rows. Null and
empty texts are scored like others, are no duplicates and hold no benchmark. An empty table stays
empty at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm import decontamination, minhash, packing, quality, toxicity
from basalt.llm.common import ODD_KEY, fold, keyed, small_batches, staged, table, without
from basalt.llm.queries import labels, packing_params

SCORE, KEY = "__score", "__key"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity is below 0.3. Repeated rows get equal scores; an empty text has the score of no evidence."""
    small_batches(spark)  # for the result, too
    learn = labels(spark, sf_dir, "toxic").where(fold(F.col("doc_id"), 4) != 2)
    scored = toxicity.score(docs, toxicity.train(docs, learn), docs.columns, name=SCORE)
    return scored.where(F.col(SCORE) < 0.3).drop(SCORE)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose quality is 0.5 or more. Repeated rows get equal scores; null texts count as empty ones."""
    small_batches(spark)  # for the result, too
    learn = labels(spark, sf_dir, "quality").where(fold(F.col("doc_id"), 3) != 1)
    scored = quality.score(docs, quality.train(docs, learn), docs.columns, name=SCORE)
    return scored.where(F.col(SCORE) >= 0.5).drop(SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest doc_id, or else of a row without an own one.

    Rows equal in doc_id and text are one; different texts of one doc_id are judged apart; texts without words all stay.
    """
    small_batches(spark)  # for the result, too
    rows = keyed(docs, KEY)
    judged = minhash.near_duplicates(rows.select(F.col(KEY).alias("doc_id"), "text"), minhash.Params(words=2))
    kept = without(rows, judged.where(~F.col("kept")).withColumnRenamed("doc_id", KEY), key=KEY)
    once = kept.where(F.col(KEY) >= ODD_KEY).dropDuplicates([KEY])
    return kept.where(F.col(KEY) < ODD_KEY).unionByName(once).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which less than 5 % of words are hit by benchmark windows; equal rows are judged alike, and all stay or go."""
    small_batches(spark)  # for the result, too
    rows = keyed(docs, KEY)
    judged = decontamination.decontaminate(rows.select(F.col(KEY).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return without(rows, judged.where("contaminated").withColumnRenamed("doc_id", KEY), key=KEY).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences of 1024 tokens; rows that share a doc_id, and those without one, are packed each."""
    small_batches(spark)  # for the result, too
    return packing.pack(docs, packing_params())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: No stage before packing can be written in SQL, so tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
