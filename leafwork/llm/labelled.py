"""Bounded labelled samples for the classifiers, without the held-out rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

HELD_OUT = "crc32(cast(coalesce(cast(doc_id AS string), '') AS binary)) % 4 = 2"


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """text, y of at most `rows` labelled documents that aren't held out, chosen by a hash of their id.

    The chosen ids are bounded by `rows`, so they alone are broadcast; texts are not shuffled. A doc_id with several
    labels has the largest; a null label is none.
    """
    usable = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~F.expr(HELD_OUT))
    ids = usable.groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    ids = ids.orderBy(F.xxhash64(F.lit(17), "doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "y")
