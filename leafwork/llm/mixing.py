"""Mixing sources to target weights by a low-discrepancy schedule.

Each source is a stream of equal blocks of words: its documents in a shuffled order, epoch after epoch. The slots of
the mix are the points frac(k * golden ratio), mapped through the cumulative targets to sources; a slot's rank among
those of its source names the block it takes. So every stretch of the mix holds the sources near their targets, and a
source takes a prefix of its stream that ends at its target.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from leafwork.llm.common import prefix, stage

WORD = r"[^\x20\x09-\x0D]+"
GOLDEN = 0.6180339887498949


def sizes(docs: DataFrame) -> DataFrame:
    """Adds size, the number of words of text (null: 0)."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def water(weights: np.ndarray, caps: np.ndarray, total: float) -> np.ndarray:
    """Shares of total by weight; what is above a cap is shared again by weight until nothing is."""
    target, open_ = np.zeros(len(weights)), np.ones(len(weights), bool)
    left = total
    while open_.any():
        share = left * weights / weights[open_].sum()
        over = open_ & (share > caps)
        if not over.any():
            target[open_] = share[open_]
            break
        target[over] = caps[over]
        left -= caps[over].sum()
        open_ &= ~over
    return target


def targets(sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target: a row for each source; weights repeat over the sources by code point, null last.

    The sources' totals come to the driver: one row per source, a figure of the catalogue that does not follow the
    number of documents. Sources without words have target 0.
    """
    rows = sized.groupBy("source").agg(F.sum("size").alias("n")).collect()
    rows = sorted(rows, key=lambda r: (r["source"] is None, r["source"] or ""))
    n = np.array([r["n"] for r in rows], float)
    w = np.array([weights[k % len(weights)] for k in range(len(rows))], float)
    t = water(w, most * n, share * n.sum())
    return sized.sparkSession.createDataFrame([(r["source"], int(r["n"]), float(x)) for r, x in zip(rows, t)], "source string, source_size long, target double")


def schedule(goals: DataFrame, block: int = 1024) -> DataFrame:
    """slot, source, rank, start, words: the mix, slot by slot; start is the block's place in its source's stream.

    Slots come from a range, so any number of executors makes them; there are as many as every source needs to reach
    its target, which is counted. Ranks are counts before a slot in its chunk of 2**16 slots plus the chunks before it.
    A source's last block ends at its target.
    """
    rows = [(r["source"], int(r["target"])) for r in goals.orderBy("source").collect()]  # one per source
    rows = [r for r in rows if r[1] > 0]
    spark = goals.sparkSession
    if not rows:
        return spark.createDataFrame([], "slot long, source string, rank long, start long, words long")
    t = np.array([r[1] for r in rows], float)
    need = np.ceil(t / block)
    edges = np.cumsum(need) / need.sum()
    upper = F.array(*(F.lit(float(e)) for e in edges))
    pick = F.least(F.size(F.filter(upper, lambda e: e <= F.col("u"))), F.lit(len(rows) - 1))
    points = int(need.sum()) + (64 if len(rows) > 1 else 0)
    while True:  # the points of an interval stray from its share by a logarithm only, so this ends soon
        slots = spark.range(points).select(F.col("id").alias("slot"), F.expr(f"(id * {GOLDEN}D) - floor(id * {GOLDEN}D)").alias("u")).select("slot", pick.alias("s"))
        got = {r["s"]: r["count"] for r in slots.groupBy("s").count().collect()}  # one per source
        if all(got.get(k, 0) >= n for k, n in enumerate(need)):
            break
        points += points // 2 + 64
    slots = slots.withColumn("chunk", F.expr("slot div 65536"))
    counts = slots.groupBy("s", "chunk").count()
    before = Window.partitionBy("s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("s", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("s", "chunk").orderBy("slot")
    ranked = slots.withColumn("r", F.row_number().over(own) - 1).join(counts, ["s", "chunk"]).withColumn("rank", F.col("base") + F.col("r"))
    named = spark.createDataFrame([(k, s, g) for k, (s, g) in enumerate(rows)], "s int, source string, goal long")
    out = ranked.join(named, "s").withColumn("start", F.col("rank") * block).filter("start < goal")
    return out.select("slot", "source", "rank", "start", F.least(F.lit(block), F.col("goal") - F.col("start")).alias("words"))


def streams(sized: DataFrame, goals: DataFrame, seed: int = 9) -> DataFrame:
    """Adds source_size, target and at, the document's place in its source's stream, shuffled by a hash of doc_id."""
    cols = [c for c in sized.columns if c not in ("source_size", "target", "at")]
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    keyed = sized.select(*cols).withColumn("_h", F.shiftleft(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), 2))
    order: list[Column] = [F.col("_h"), F.col("doc_id"), *([F.xxhash64("text")] if "text" in cols else []), F.col("size")]
    placed = prefix(keyed, ["source"], order, F.col("size"), "at")
    g = goals.select(F.col("source").alias("_s"), "source_size", "target")
    return placed.join(F.broadcast(g), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "_h")  # one row per source


def blocks(placed: DataFrame, plan: DataFrame, block: int = 1024) -> DataFrame:
    """slot, source, at, doc_id, epoch, first, words: the pieces of documents in each slot of the schedule.

    A document meets the blocks that its place in each epoch overlaps: an equality join on source and block.
    """
    spans = placed.filter("size > 0").select("source", "doc_id", "at", "size", "source_size", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("epoch"))
    spans = spans.withColumn("lo", F.expr("at + epoch * source_size")).withColumn("hi", F.expr("lo + size"))
    cut = spans.withColumn("rank", F.explode(F.expr(f"sequence(lo div {block}, (hi - 1) div {block})")))
    p = plan.select(F.col("source").alias("_s"), F.col("rank").alias("_r"), "slot", "start", F.col("words").alias("_w"))
    met = cut.join(p, F.col("_s").eqNullSafe(F.col("source")) & (F.col("rank") == F.col("_r")))
    met = met.withColumn("a", F.greatest("lo", "start")).withColumn("b", F.least("hi", F.col("start") + F.col("_w"))).filter("a < b")
    return met.select("slot", "source", "at", "doc_id", "epoch", F.expr("a - lo").alias("first"), F.expr("b - a").alias("words"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = 1024, seed: int = 9) -> tuple[DataFrame, DataFrame]:
    """(docs with size, source_size, target, at, first_take, second_take, taken; the schedule).

    docs has doc_id, source and text, or the texts' size in its place; columns of the new names are replaced.

    The takes are the words that the schedule's blocks hold of the document in the first and in the second epoch, each
    from its first word on; most must not be above 2. A null source is a source of its own, named last. Null, empty
    and blank texts have size 0 and are taken with 0 words. Repeated rows are rows of their own. Columns that docs has
    beside these stay.
    """
    if most > 2:
        raise ValueError("a document is taken in two epochs at most")
    sized = sizes(docs) if "text" in docs.columns else docs
    goals = targets(sized, weights, share, most)
    plan = schedule(goals, block)
    placed = stage(streams(sized, goals, seed), "streams")
    got = blocks(placed, plan, block).groupBy("source", "at").agg(
        F.sum(F.when(F.col("epoch") == 0, F.col("words")).otherwise(0)).alias("first_take"), F.sum(F.when(F.col("epoch") == 1, F.col("words")).otherwise(0)).alias("second_take")
    )
    got = got.select(F.col("source").alias("_s"), F.col("at").alias("_a"), "first_take", "second_take")
    # two documents at one place: all but one have no words
    out = placed.join(got, F.col("source").eqNullSafe(F.col("_s")) & (F.col("at") == F.col("_a")) & (F.col("size") > 0), "left").drop("_s", "_a")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("first_take", "second_take")})
    return out.withColumn("taken", F.col("first_take") + F.col("second_take")), plan


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: a document's text as often as it is taken whole, then cut after its last taken word.

    Columns as in docs; n_chars, if there, is the new text's. Texts go through one shuffle: the mix is made of sizes.
    Rows that share doc_id and text are each taken as the one of them that is taken most.
    """
    mark = F.xxhash64("text").alias("_x")
    sized = stage(sizes(docs.select("doc_id", "source", "text")).select("doc_id", "source", "size", mark), "sized")  # words are counted once
    took, _ = mix(sized, **options)
    took = took.filter("taken > 0").groupBy("doc_id", "_x").agg(F.max("taken").alias("_taken"), F.max("size").alias("_size"))
    took = took.withColumnRenamed("doc_id", "_d").withColumnRenamed("_x", "_y")
    rows = docs.withColumn("_x", mark).join(took, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_x") == F.col("_y")))
    rows = rows.withColumn("_take", F.explode(F.expr("concat(array_repeat(_size, int(_taken div _size)), filter(array(_taken % _size), x -> x > 0))")))
    space = r"\\x20\\x09-\\x0D"
    cut = F.expr(f"array_join(slice(regexp_extract_all(text, '([{space}]*[^{space}]+)', 1), 1, int(_take)), '')")
    rows = rows.withColumn("text", F.when(F.col("_take") < F.col("_size"), cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)
