"""Sources, sinks, streams and the sequential merges."""

import io
import zipfile

from leafwork.operators.merging import merge_fragments, merge_reason, merge_zones
from leafwork.plans import page_queries
from leafwork.plans.frame import over_tables
from leafwork.sources import files, sinks
from leafwork.sources.blocks import blocks
from leafwork.streaming import markdown_stream

BOX = "doc_id long, page_num int, idx int, text string, x0 double, y0 double, x1 double, y1 double"


def test_merge_fragments(spark):
    rows = [(1, 1, 0, "f(x) =", 0.0, 100.0, 30.0, 115.0), (1, 1, 1, "2x + 1", 32.0, 100.0, 60.0, 115.0), (1, 1, 2, "alone", 0.0, 300.0, 30.0, 315.0), (1, 2, 0, "(a", 0.0, 0.0, 5.0, 10.0), (1, 2, 1, "b)", 0.0, 35.0, 5.0, 45.0)]
    got = merge_fragments(spark.createDataFrame(rows, BOX)).orderBy("page_num", "formula_no").collect()
    assert [(r.text, r.n) for r in got] == [("f(x) = 2x + 1", 2), ("alone", 1), ("(a b)", 2)]
    assert (got[0].confidence, got[2].confidence) == (0.85, 0.95)
    assert merge_reason("a", 0, 10, "+ b", 12) is None and merge_reason("a", 0, 10, "= b", 12) == "syntactic_bridge"


def test_merge_zones(spark):
    rows = [(1, 1, 0.0, 0.0, 50.0, 10.0, 0.5, ["b"]), (1, 1, 10.0, 25.0, 60.0, 40.0, 0.7, ["a"]), (1, 1, 0.0, 90.0, 50.0, 99.0, 0.4, [])]
    got = merge_zones(spark.createDataFrame(rows, "doc_id long, page_num int, x0 double, y0 double, x1 double, y1 double, confidence double, hints array<string>")).orderBy("y0").collect()
    assert [(r.y0, r.y1, r.confidence, r.hints) for r in got] == [(0.0, 40.0, 0.7, ["a", "b"]), (90.0, 99.0, 0.4, [])]


def test_files(spark, tmp_path):
    for name, data in (("a.pdf", b"%PDF"), ("b.txt", b"x"), ("c.PDF", b"%PDF"), ("d.pdf", b"%PDF" * 9)):
        (tmp_path / name).write_bytes(data)
    got = {r.name: r.status for r in files.uploads(spark, f"file://{tmp_path}", most_bytes=20).collect()}
    assert got == {"a": "accepted", "b": "wrong_type", "c": "accepted", "d": "too_large"}


def test_spans(spark):
    rows = [(1, 1, 0, 0, 1, "mundo", 10.0, 16, "F", 5.0, 0.0, 9.0, 8.0), (1, 1, 0, 0, 0, "Olá ", 14.0, 2, "F", 0.0, 1.0, 5.0, 9.0), (1, 1, 0, 1, 0, " ", 9.0, 0, "F", 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, page_num int, block_idx int, line_idx int, span_idx int, text string, size double, flags int, font string, x0 double, y0 double, x1 double, y1 double")
    (r,) = files.blocks_from_spans(df).collect()
    assert (r.text, r.font_size, r.font_flags, r.bold, r.x0, r.y1) == ("Olá mundo", 14.0, 18, True, 0.0, 9.0)


def test_archives(spark):
    docs = spark.createDataFrame([(1, "um", "# Olá")], "doc_id long, name string, markdown string")
    images = spark.createDataFrame([(1, "images/a.png", bytearray(b"\x89PNG"))], "doc_id long, path string, bytes binary")
    (r,) = sinks.archives(docs, images).collect()
    with zipfile.ZipFile(io.BytesIO(r.archive)) as z:
        assert r.name == "um_completo.zip" and z.namelist() == ["images/a.png", "um.md"] and z.read("um.md").decode() == "# Olá"


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "Um texto comum aqui.\nOutra linha de texto.")], "doc_id long, text string").write.parquet(f"file://{tmp_path}/in")
    markdown_stream(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination()
    assert "Outra linha" in spark.read.parquet(f"file://{tmp_path}/out").first()["markdown"]


def test_words_hold_whole_lines(spark, sf):
    lines = over_tables(blocks)(spark, sf).filter("doc_id >= 0").selectExpr("doc_id", "page_num", "block_idx AS idx", "text AS line")
    words = over_tables(page_queries._words)(spark, sf).filter("doc_id >= 0").join(lines, ["doc_id", "page_num", "idx"], "full")
    assert words.filter("NOT text <=> line").count() == 0 and words.filter("length(text) > 12").count() > 0
