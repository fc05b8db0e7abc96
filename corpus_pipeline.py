"""A corpus pipeline over documents: toxicity, near-dedup, repeated passages, mixing, packing.

Each stage is one operator of leafwork.llm on all documents that its predecessor kept. The first four return the
columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from leafwork.llm import chosenpath, factorization, mixing, packing, repeats
from leafwork.llm.common import stage
from leafwork.llm.queries import TOKENIZER

#: No stage can be checked by SQL: a trained model, 64-bit shingles, byte strings, a tokenizer. See tests/llm.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine doesn't call toxic (score below 0.3); it learns from labels, without the held-out rows.

    Null and empty texts stay, repeated rows go or stay together; without any label nothing goes.
    """
    model = factorization.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic")
    scored = factorization.score(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text"), model)
    return scored.filter("score < 0.3").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id; documents without words stay."""
    return chosenpath.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the bytes of 100-byte strings that start earlier."""
    return repeats.without_repeats(docs, length=100)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as the schedule takes them, the last of a source cut where it ends.

    Null, empty and blank texts have no words and are not taken; a null source is a source of its own.
    """
    return mixing.mixed_texts(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their ids and places in sequences of 1024 tokens; a null or empty text is its end id alone."""
    return packing.pack(docs, TOKENIZER, full=1024, end_id=2, added=True)


STAGES = [("toxicity", toxicity), ("near-dedup", near_dedup), ("repeated passages", repeated_passages), ("mixing", mixture), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each stage's result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
