"""Shared tools: staged tables in the cluster's shared folder, prefix ranks without a hot task, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from leafwork.session import ship

_OWN: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local one only where that is unset and all runs in one process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = "file://" + tempfile.mkdtemp(prefix="leafwork-")
    return _OWN["dir"]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: lineage ends here and lost executors cost nothing.

    The shuffle files of that one job go as it ends (Spark's own clean-up of a finished query); what reads the table
    later doesn't need them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(schema).parquet(path)


def discard(*tables: DataFrame | None) -> None:
    """Deletes staged tables that are read no more."""
    for df in tables:
        if df is None:
            continue
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Readies a session for Python work on texts: Arrow batches of few rows, as one text can be very long (a value set
    by the user stays), and this package on the executors."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(rows))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def prefix(df: DataFrame, group: list[str], order: list, value, out: str, per_bucket: int = 4096, rows: int | None = None) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows before this one in its group.

    `order` starts with a column `_h` of uniform longs in [0, 2**62), so that equal hash ranges hold about equal
    numbers of rows: sums per (group, range) are taken first with map-side combining, summed up over the ranges, and
    only rows of one range ever meet in one task. A group may hold all rows.
    """
    rows = df.count() if rows is None else rows
    buckets = max(1, -(-rows // per_bucket))
    width = -(-(1 << 62) // buckets)
    cut = df.withColumn("_b", F.expr(f"_h div {width}L")).withColumn("_v", value.cast("long"))
    keys = [F.coalesce(F.col(g).cast("string"), F.lit("\0null")).alias(f"_k{i}") for i, g in enumerate(group)]
    names = [f"_k{i}" for i in range(len(group))]
    cut = cut.select("*", *keys)
    # the sums over ranges are dealt by blocks of 1024 ranges, so that one group's ranges don't meet in a task either
    sums = cut.groupBy(*names, "_b").agg(F.sum("_v").alias("_s")).withColumn("_c", F.expr("_b div 1024"))
    blocks = sums.groupBy(*names, "_c").agg(F.sum("_s").alias("_cs"))
    before = Window.partitionBy(*names).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*names, "_c", F.coalesce(F.sum("_cs").over(before), F.lit(0)).alias("_c0"))
    before = Window.partitionBy(*names, "_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_b0", F.coalesce(F.sum("_s").over(before), F.lit(0)))
    starts = sums.join(blocks, [*names, "_c"]).select(*names, "_b", (F.col("_b0") + F.col("_c0")).alias("_0"))
    before = Window.partitionBy(*names, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut.join(starts, [*names, "_b"])
        .withColumn(out, F.col("_0") + F.coalesce(F.sum("_v").over(before), F.lit(0)))
        .drop("_b", "_v", "_0", *names)
    )


def hashed(*cols, seed: int = 0):
    """A uniform long in [0, 2**62) of the columns: the `_h` of prefix()."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 2)


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(id, component) of every id in edges (a, b): the smallest id reachable; large-star and small-star steps.

    Each step keeps the graph's components and shortens its paths; it ends when nothing changes. Every table stays
    distributed. A hub's neighbours are joined, never gathered.
    """
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    pairs = stage(pairs, "edges")
    seen = None
    for _ in range(limit):
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour of u meets the smallest of u's neighbourhood
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: u and its smaller neighbours meet the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), "m").union(low.select("u", "m"))
        before, after = pairs, stage(small.filter("u <> m").select(F.col("m").alias("a"), F.col("u").alias("b")).distinct(), "edges")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        pairs = after
        discard(before)
        if seen is not None and tuple(mark) == seen:
            break
        seen = tuple(mark)
    else:
        raise RuntimeError(f"components did not settle in {limit} steps")
    # settled: stars only, a is the smallest of its component
    return pairs.select(F.col("b").alias("id"), F.col("a").alias("component")).union(pairs.select(F.col("a"), F.col("a")).distinct())
