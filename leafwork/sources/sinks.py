"""Where results go: one Markdown text per document, and archives of texts with their images."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from leafwork.session import ship


def write_markdown(documents: DataFrame, folder: str) -> None:
    """Writes doc_id, markdown as Parquet partitions of one row per document; stores hold few large files better than many small ones."""
    documents.select("doc_id", "markdown").write.mode("overwrite").parquet(folder)


def write_markdown_files(documents: DataFrame, folder: str) -> DataFrame:
    """doc_id, path of documents (doc_id, name, markdown) written as one .md file each; folder is a path or URI that all executors reach.

    Names lose what file systems do not allow; a document's id keeps equal names apart. A repeated task writes the same files again.
    """
    ship(documents.sparkSession)
    safe = F.regexp_replace(F.coalesce("name", F.lit("document")), r'[<>:"/\\|?*]', "_")
    named = documents.select("doc_id", F.concat(safe, F.lit("_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file"), F.coalesce("markdown", F.lit("")).alias("markdown"))

    def write(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(root, recursive=True)
        for df in batches:
            for name, text in zip(df["file"], df["markdown"]):
                with store.open_output_stream(f"{root}/{name}") as out:
                    out.write(text.encode())
            yield pd.DataFrame({"doc_id": df["doc_id"], "path": f"{folder.rstrip('/')}/" + df["file"]})

    return named.mapInPandas(write, "doc_id long, path string")


def archives(documents: DataFrame, images: DataFrame) -> DataFrame:
    """doc_id, name, archive (zip) of documents (doc_id, name, markdown) and images (doc_id, path, bytes).

    One document's files meet in one task; entries are sorted and dated alike, so that repeated runs agree.
    """
    ship(documents.sparkSession)
    texts = documents.select("doc_id", "name", F.concat("name", F.lit(".md")).alias("path"), F.encode("markdown", "UTF-8").alias("bytes"))
    files = texts.unionByName(images.select("doc_id", F.lit(None).cast("string").alias("name"), "path", "bytes"))

    def one(df: pd.DataFrame) -> pd.DataFrame:
        names = df["name"].dropna()
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for path, data in sorted(zip(df["path"], df["bytes"])):
                z.writestr(zipfile.ZipInfo(path, (1980, 1, 1, 0, 0, 0)), bytes(data))
        name = f"{names.iloc[0]}_completo.zip" if len(names) else None
        return pd.DataFrame([(df["doc_id"].iloc[0], name, out.getvalue())], columns=["doc_id", "name", "archive"])

    return files.groupBy("doc_id").applyInPandas(one, "doc_id long, name string, archive binary")
