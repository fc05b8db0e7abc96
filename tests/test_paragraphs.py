"""Paragraph assembly against a sequential reading of its rules, and its independence of order and partitioning."""

import random

from leafwork.operators import paragraphs
from leafwork.operators.geometry import lines

KIND = "doc_id long, page_num int, block_idx int, text string, font_size double, bold boolean"


def blocks(spark, rows):
    return spark.createDataFrame([(1, 1 + i // 40, i, t, float(s), b) for i, (t, s, b) in enumerate(rows)], KIND)


def test_units(spark):
    rows = [
        ("CAPÍTULO 1 - Introdução", 18, True), ("Este texto começa aqui e", 12, False), ("segue na linha de baixo.", 12, False), ("Outro parágrafo começa depois", 12, False), ("- primeiro item", 12, False),
        ("continua assim", 12, False), ("- segundo item da lista", 12, False), ("Uma frase comum depois da lista inteira", 12, False), ("Texto em negrito", 12, True), ("2.5 metros de largura", 12, False),
    ]
    got = [(r.kind, r.body) for r in paragraphs.consolidate(blocks(spark, rows)).orderBy("unit").collect()]
    assert got == [
        ("heading", "# CAPÍTULO 1 - Introdução"), ("text", "Este texto começa aqui e segue na linha de baixo."), ("text", "Outro parágrafo começa depois"), ("item", "- primeiro item continua assim"),
        ("item", "- segundo item da lista"), ("text", "Uma frase comum depois da lista inteira **Texto em negrito**"), ("heading", "**2.5 metros de largura**"),
    ]


def test_order_and_partitions_do_not_matter(spark):
    words = ["texto comum", "- item", "fim.", "Começo de frase", "a) letra", "1.1 Seção", "curto;", "negrito aqui"]
    rng = random.Random(5)
    rows = [(f"{rng.choice(words)} número {rng.choice('abcdef')}", rng.choice([12, 12, 16]), rng.random() < 0.2) for _ in range(80)]
    df = blocks(spark, rows)
    base = paragraphs.to_markdown(df).collect()
    shuffled = spark.createDataFrame(rng.sample(df.collect(), df.count()), KIND).repartition(7)
    assert paragraphs.to_markdown(shuffled).collect() == base


def test_empty(spark):
    assert paragraphs.to_markdown(blocks(spark, [("x", 12, False)]).limit(0)).collect() == []


def test_lines(spark):
    rows = [(1, 1, 0, "a+b", 0.0, 100.0, 30.0, 115.0), (1, 1, 1, "c+d", 0.0, 130.0, 30.0, 145.0), (1, 1, 2, "z", 40.0, 103.0, 50.0, 116.0), (1, 1, 3, " ", 0.0, 0.0, 1.0, 1.0)]
    got = lines(spark.createDataFrame(rows, "doc_id long, page_num int, idx int, text string, x0 double, y0 double, x1 double, y1 double")).orderBy("line_no").collect()
    assert [(r.line_no, r.text) for r in got] == [(0, "a+b z"), (1, "c+d")]
