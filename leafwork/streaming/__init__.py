"""New texts as they arrive: each micro-batch goes through the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from leafwork.operators.paragraphs import to_markdown
from leafwork.sources.blocks import blocks_from_texts


def markdown_stream(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Parquet files of (doc_id, text) that appear in source become Markdown in target, a folder per batch, so that a repeated batch replaces itself."""
    texts = spark.readStream.schema("doc_id long, text string").parquet(source)

    def batch(df: DataFrame, number: int) -> None:
        to_markdown(blocks_from_texts(df)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return texts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
