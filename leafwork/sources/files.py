"""Files as pages: uploads with their checks, and page tables from a decoder where one is installed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

MOST_BYTES = 500 * 1024 * 1024


def uploads(spark: SparkSession, paths: list[str] | str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """path, name, size, status of files: accepted, wrong_type, empty or too_large. Contents are not read.

    Spark lists no files without bytes unless told to split them singly, so empty ones may be missing altogether.
    """
    files = spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("size"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    status = F.when(~F.lower("path").endswith(".pdf"), "wrong_type").when(F.col("size") == 0, "empty").when(F.col("size") > most_bytes, "too_large").otherwise("accepted")
    return files.select("path", F.regexp_replace(name, r"\.[^.]*$", "").alias("name"), "size", status.alias("status"))


def spans_from_files(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """doc_id, page_num, block_idx, line_idx, span_idx, text, size, flags, font, x0..y1 of the accepted files' text spans.

    Needs a decoder (pymupdf) on the executors; without one, start from a table of spans.
    """
    try:
        import pymupdf  # noqa: F401
    except ImportError as e:
        raise RuntimeError("no decoder is installed; give a table of spans instead") from e

    def decode(batches):
        import pandas as pd
        import pymupdf

        for df in batches:
            rows = []
            for path, content in zip(df["path"], df["content"]):
                with pymupdf.open(stream=content, filetype="pdf") as doc:
                    for p, page in enumerate(doc, 1):
                        for b, block in enumerate(x for x in page.get_text("dict")["blocks"] if x["type"] == 0):
                            for ln, line in enumerate(block["lines"]):
                                rows += [(path, p, b, ln, k, s["text"], s["size"], s["flags"], s["font"], *s["bbox"]) for k, s in enumerate(line["spans"])]
            yield pd.DataFrame(rows, columns=["path", "page_num", "block_idx", "line_idx", "span_idx", "text", "size", "flags", "font", "x0", "y0", "x1", "y1"])

    files = spark.read.format("binaryFile").load(paths).filter("length > 0 AND lower(path) LIKE '%.pdf'").select("path", "content")
    kind = "path string, page_num int, block_idx int, line_idx int, span_idx int, text string, size double, flags int, font string, x0 double, y0 double, x1 double, y1 double"
    return files.mapInPandas(decode, kind).withColumn("doc_id", F.xxhash64("path"))


def blocks_from_spans(spans: DataFrame) -> DataFrame:
    """Lines of spans as blocks: texts in order without a separator, the largest size (12 at least), flags united, the outer box."""
    line = spans.groupBy("doc_id", "page_num", "block_idx", "line_idx").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_idx", "text"))), lambda s: s["text"]), "").alias("text"),
        F.greatest(F.lit(12.0), F.max("size")).alias("font_size"), F.bit_or("flags").alias("font_flags"), *(F.min(c).alias(c) for c in ("x0", "y0")), *(F.max(c).alias(c) for c in ("x1", "y1")),
    )
    order = F.row_number().over(Window.partitionBy("doc_id", "page_num").orderBy("block_idx", "line_idx"))
    return line.filter(F.trim("text") != "").withColumn("block_idx", (order - 1).cast("int")).withColumn("bold", F.col("font_flags").bitwiseAND(16) != 0).drop("line_idx")
