"""The queries of the corpus operators: thin, each gets its rows from its operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from leafwork.llm import bitpack, chosenpath, factorization, forest, mixing, packing, repeats, routing, rules, urls
from leafwork.llm.common import stage

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = rules.fit(docs, table(spark, sf_dir, "labels"), "quality")
    out = rules.score(docs, model)
    return out.select("doc_id", "held_out", "score", F.expr("int(score >= 0.7)").alias("predicted"))


def op2_chosen_path_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosenpath.near_duplicates(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, full=1024, end_id=2, with_ids=False, added=True)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_bit_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = bitpack.round_trip(table(spark, sf_dir, "documents"), TOKENIZER, end_id=0, added=True)
    return back.select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op6_toxicity_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = factorization.fit(docs, table(spark, sf_dir, "labels"), "toxic")
    out = factorization.score(docs, model)
    return out.select("doc_id", "held_out", "score", F.expr("int(score >= 0.3)").alias("predicted"))


def op7_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return routing.search(rows, rows.filter("vec_id % 20 = 0"), top=20)


#: The rules of the URL query.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = urls.judge(pages, [urls.rule(*r) for r in URL_RULES], urls.fit())
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_source_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = stage(mixing.sizes(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text"), "sized")  # words are counted once
    took, _ = mixing.mix(sized)
    return took.select("doc_id", "size", "source_size", "target", "taken")


def op10_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=100)
    return judged.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def queries() -> dict:
    found = (op1_quality_rules, op2_chosen_path_dedup, op3_best_fit_packing, op4_bit_packed_ids, op5_projection_forest, op6_toxicity_machine, op7_learned_partitions, op8_url_filter, op9_source_schedule, op10_suffix_repeats)
    return {f.__name__: f for f in found}


#: The mix in closed form: capped sources are the first by cap and weight, and the blocks tile a prefix of each stream.
OP9_SQL = r"""
WITH s AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
n AS (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM s GROUP BY source),
w AS (SELECT source, n, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w FROM n),
r AS (
  SELECT source, n, w, 2.0 * CAST(n AS DOUBLE) AS cap, CAST(1.5 AS DOUBLE) * sum(n) OVER () AS total, row_number() OVER o AS k,
    coalesce(sum(2.0 * CAST(n AS DOUBLE)) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken_before, sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_rest
  FROM w WINDOW o AS (ORDER BY 2.0 * CAST(n AS DOUBLE) / w, source NULLS LAST)
),
f AS (SELECT total - taken_before AS left_over, w_rest AS open_weight FROM r WHERE (total - taken_before) * w / w_rest <= cap ORDER BY k LIMIT 1),
t AS (SELECT source, n, least(cap, left_over * w / open_weight) AS target FROM r, f),
p AS (
  SELECT s.doc_id, s.size, t.n AS source_size, t.target, CAST(floor(t.target) AS BIGINT) AS goal,
    CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY substr(md5('9:' || coalesce(CAST(s.doc_id AS VARCHAR), '')), 1, 15), s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  greatest(0, least(place + size, goal) - place) + greatest(0, least(place + source_size + size, goal) - (place + source_size)) AS taken
FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_source_schedule": OP9_SQL}
