"""Text and list operators against values worked out by hand from their rules."""

import pytest

from leafwork.functions import headings as H, lists as L, text as T
from leafwork.functions.dialect import SPARK as d


def one(spark, sql_of, text):
    return spark.createDataFrame([(text,)], "t string").selectExpr(f"{sql_of('t')} AS v").first()["v"]


@pytest.mark.parametrize("raw, want", [
    ("12 Exemplos", "Exemplos"), ("fim da linha  12", "fim da linha"), ("$12$ resto", "resto"), ("$3 Abc$ x", "Abc x"), ("x     y", "x  y"), ("a\tb", "a b"), ("", ""), (" \n ", ""),
    (" + ", "α + β"), (" feito", "✔ feito"), ("x", "∑x"), ("a", "a"), ("a\x07b", "ab"), ("𝑓(𝑥)", "𝑓(𝑥)"),
])
def test_clean_text(spark, raw, want):
    assert one(spark, lambda x: T.clean_text(d, x), raw) == want


@pytest.mark.parametrize("text, want", [
    ("17", True), ("Página 12", True), ("MEC012 x", True), ("a  b  c", False), ("Universidade Federal de X", True), ("texto  12", True), ("texto normal", False), ("1", False), ("x" * 121 + " – 12", True),
])
def test_furniture(spark, text, want):
    assert one(spark, lambda x: T.is_page_furniture(d, x), text) is want


@pytest.mark.parametrize("text, want", [("ab", True), ("1 2 3 – 4", True), ("f(x) = 2x", False), ("α + β = γ", True), ("x" * 25, True), ("duas palavras aqui e mais texto", False)])
def test_garbage(spark, text, want):
    assert one(spark, lambda x: T.is_garbage(d, x), text) is want


@pytest.mark.parametrize("text, size, candidate, level", [
    ("CAPÍTULO 1 - Introdução", 18, True, 1), ("1.1 Contexto", 14, True, 2), ("1.2.3 Sub", 12, True, 3), ("1.2.3.4 Outra", 12, True, 4), ("2.5 metros", 12, True, 0), ("2.13 – Tabela", 20, False, 0),
    ("Figura 1: x", 20, False, 0), ("resultado de", 12, False, 0), ("Um Teste", 18, False, 0), ("abc", 18, False, 0), ("TÍTULO DO TEXTO", 24, True, 1), ("x" * 151, 12, False, 0),
])
def test_heading_rules(spark, text, size, candidate, level):
    assert one(spark, lambda x: T.is_heading_candidate(d, x, str(size)), text) is candidate
    assert one(spark, lambda x: T.heading_level(d, x, str(size)), text) == level


@pytest.mark.parametrize("text, kind, markdown", [
    ("• Item", "bullet", "- Item"), ("12) x", "numbered", "12. x"), ("a) massa", "lettered", "a) massa"), ("i. item", "lettered", "i) item"), ("iv) parte", "roman", "iv. parte"),
    ("1. Introdução – Conceitos", "numbered", "1. Introdução – Conceitos"), ("1. Conceitos – x", "none", "1. Conceitos – x"), ("1.1 – Mecânica", "none", "1.1 – Mecânica"), ("☐ tarefa", "checkbox", "- tarefa"), ("texto", "none", "texto"), ("-5 graus", "bullet", "- 5 graus"),
])
def test_list_items(spark, text, kind, markdown):
    k, m, c = (lambda x: L.list_parts(d, x))("t")
    assert one(spark, lambda x: k, text) == kind
    assert one(spark, lambda x: L.list_markdown(d, x, k, m, c), text) == markdown
    assert one(spark, lambda x: L.is_list_item(d, x), text) is (kind != "none")


@pytest.mark.parametrize("text, points", [("CAPÍTULO 1", 2), ("Conclusão", 1), ("12", -10), ("• item de lista", -7), ("1.1 Contexto", 2)])
def test_quick_points(spark, text, points):
    assert one(spark, lambda x: H.quick_points(d, x, "12.0", "FALSE", "12.0"), text) == points
