"""Runs one SQL specification on Spark DataFrames, or prints it for DuckDB."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafwork.functions.dialect import DUCK, SPARK, Dialect

Spec = Callable[[Dialect], str]
_TABLE = re.compile(r"@(\w+)@")


def apply(spec: Spec, **frames: DataFrame) -> DataFrame:
    """The spec over DataFrames: @name@ in its SQL stands for the frame of that name."""
    spark = next(iter(frames.values())).sparkSession
    names = {}
    for k, df in frames.items():
        names[k] = f"leafwork_{k}_{uuid.uuid4().hex[:12]}"
        df.createOrReplaceTempView(names[k])
    try:
        return spark.sql(_TABLE.sub(lambda m: names[m[1]], spec(SPARK)))
    finally:
        for name in names.values():  # the plan holds what they stood for
            spark.catalog.dropTempView(name)


def literal(spec: Spec) -> str:
    """The spec as DuckDB SQL over views of the tables' names."""
    return _TABLE.sub(lambda m: m[1], spec(DUCK))


def read(spark: SparkSession, path: str) -> DataFrame:
    """A table; one that comes in fewer parts than there are cores, as a small file does, is dealt out by its first column."""
    table = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    few = 1 < cores and table.rdd.getNumPartitions() < cores
    return table.repartition(cores, table.columns[0]) if few else table


def over_tables(spec: Spec) -> Callable[[SparkSession, str], DataFrame]:
    """A query callable that reads the tables which the spec names."""
    used = sorted(set(_TABLE.findall(spec(SPARK))))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if not used:
            return spark.sql(spec(SPARK))
        return apply(spec, **{t: read(spark, f"{sf_dir}/{t}.parquet") for t in used})

    return run
