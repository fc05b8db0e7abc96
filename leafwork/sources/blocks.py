"""Blocks (lines with typography) as SQL: from a table of texts, or literal fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame

from leafwork.functions.dialect import Dialect
from leafwork.plans.frame import apply

#: Lines on a page where a text has no pages of its own.
PAGE = 40

#: Lines that exercise every operator, as documents with negative ids.
FIXTURE = [
    "CAPÍTULO 1 - Introdução", "1.1 Contexto do Problema", "Este é um parágrafo normal de texto que deveria ser identificado como corpo.", "• Item de lista com bullet", "Conclusão",
    "TÍTULO DO DOCUMENTO", "Texto normal", "Título Principal", "Figura 1: Uma imagem importante", "- Item 1 da lista", "- Item 2 da lista",
    "  Ação de fluidos sobre superfícies submersas, ex.: barragens;", "1.1 – Mecânica dos Fluidos", "a) massa específica", "b) peso específico", "i. item", "12) x", "1. Introdução – Conceitos",
    "texto:  Item1;  Item2;  Item3;", "f(x) = 2x + 1", "α + β = γ", "∑ x² + ∫ y dy", "a prose line without anything in it", "12 Exemplos de uso", "fim da linha  12", "$12$ resto $3 Abc$", "MEC012 – Notas de aula",
    "Universidade Federal de Teste", "Página 12", "17", "x\ty   z", "H₂O", "x²", "ÁGUA", "ab", "   ", "P.V = n.R.T (2.10)", "sen alpha = 1/2", "V P T = sendo", "2.5 metros", "2.13 – Tabela",
    "mil x", "AB123", "CAPÍTULO 2", "continua;", "Resumo", "www.exemplo.com/a/b", "Ver *Figura 2* abaixo e Tab. 3.", "*Figura 3*", "Fig. 4.", "Quadro 5:", "Gráfico 6", "Table 1 caption", "IV. Metodologia",
    "☐ tarefa", "2- segunda", "x: primeiro;  segundo item;  terceiro item; quarto", "Sistema MKS m kg s", "1 2 3 – 4", "Um Teste", "abc", "SEÇÃO 3 de", "resultado de", "A = B + C", "E", "=", "mc²",
    "(3.4)", "   espaços   ", "Texto em negrito", "1.2.3 Subseção", "1.2.3.4 Outra", "x" * 151, "y" * 201, "nota com 50% e k = 3·10² [m/s]", "log(x) + exp(y)", "{[(", "x_1 + x_2", "a/b",
]


def fixture(d: Dialect) -> str:
    """doc_id, i, raw of the fixture: documents -1, -2 and so on of PAGE lines each."""
    rows = ", ".join(f"({-1 - k // PAGE}, {k % PAGE}, {d.lit(t)})" for k, t in enumerate(FIXTURE))
    return f"SELECT CAST(a AS BIGINT) AS doc_id, CAST(b AS INT) AS i, c AS raw FROM (VALUES {rows}) AS v(a, b, c)"


def lines(d: Dialect, table: str = "@documents@") -> str:
    """doc_id, i, raw of every line of the texts."""
    if d.spark:
        return f"SELECT doc_id, l.pos AS i, l.col AS raw FROM {table} LATERAL VIEW posexplode(split(text, '\\n')) l"
    return f"SELECT doc_id, CAST(unnest(range(len(l))) AS INT) AS i, unnest(l) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM {table}) AS s"


def blocks(d: Dialect, source: str | None = None) -> str:
    """doc_id, page_num, block_idx, text (stripped), raw, font_size, font_flags, bold, y_ratio of the lines that aren't blank.

    Sizes and weights are laid on by the line's number: 24 points for the first line, 20 every thirtieth, 16 every tenth, bold every twentieth.
    """
    source = source or f"{lines(d)} UNION ALL {fixture(d)}"
    div = "CAST(floor(i / 40.0) AS INT)"
    named = d.once(source, text=d.strip("raw"))
    return (
        f"SELECT doc_id, {div} + 1 AS page_num, i AS block_idx, text, raw, CASE WHEN i = 0 THEN {d.double('24')} WHEN i % 30 = 0 THEN {d.double('20')} WHEN i % 10 = 0 THEN {d.double('16')} ELSE {d.double('12')} END AS font_size,"
        f" CASE WHEN i % 20 = 0 THEN 16 ELSE 0 END AS font_flags, i % 20 = 0 AS bold, (i % 100) / {d.double('100')} AS y_ratio FROM ({named}) AS b WHERE text <> ''"
    )


def blocks_from_texts(docs: DataFrame) -> DataFrame:
    """blocks() of a DataFrame with doc_id and text."""
    return apply(lambda d: blocks(d, lines(d)), documents=docs)
