"""Mathematical notation: counts, scores, classes, merging of fragments, conversion to LaTeX."""

from __future__ import annotations

from leafwork.functions.dialect import Dialect, NW, S, S_IN, W
from leafwork.functions.text import FUNCTIONS, GREEK_WORDS, isolated_letters, word

# Character sets and their LaTeX.
GREEK_LOWER = "αβγδεζηθικλμνξοπρστυφχψω"
GREEK_UPPER = "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"
SUPERSCRIPTS, SUPER_PLAIN = "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿⁱ", "0123456789+-=()ni"
SUBSCRIPTS, SUB_PLAIN = "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎ₐₑₒₓ", "0123456789+-=()aeox"
ZONE_CHARS = "+-×÷·±∓=≠≈≡≤≥<>∞∑∏∫∬∭∮∂∇√∛∜∈∉⊂⊃⊆⊇∩∪∅∀∃∄¬∧∨→←↔⇒⇐⇔↑↓↕⇑⇓°′″‰∝∠∥⊥" + GREEK_LOWER + GREEK_UPPER + SUPERSCRIPTS + SUBSCRIPTS
ITALIC = r"\x{1D400}-\x{1D7FF}"
LATEX = {
    "α": r"\alpha", "β": r"\beta", "γ": r"\gamma", "δ": r"\delta", "ε": r"\epsilon", "ζ": r"\zeta", "η": r"\eta", "θ": r"\theta", "ι": r"\iota", "κ": r"\kappa", "λ": r"\lambda", "μ": r"\mu",
    "ν": r"\nu", "ξ": r"\xi", "π": r"\pi", "ρ": r"\rho", "σ": r"\sigma", "τ": r"\tau", "υ": r"\upsilon", "φ": r"\phi", "χ": r"\chi", "ψ": r"\psi", "ω": r"\omega",
    "Γ": r"\Gamma", "Δ": r"\Delta", "Θ": r"\Theta", "Λ": r"\Lambda", "Ξ": r"\Xi", "Π": r"\Pi", "Σ": r"\Sigma", "Φ": r"\Phi", "Ψ": r"\Psi", "Ω": r"\Omega",
    "∑": r"\sum", "∏": r"\prod", "∫": r"\int", "∂": r"\partial", "∇": r"\nabla", "∞": r"\infty", "±": r"\pm", "×": r"\times", "÷": r"\div", "·": r"\cdot", "≤": r"\leq", "≥": r"\geq",
    "≠": r"\neq", "≈": r"\approx", "≡": r"\equiv", "∈": r"\in", "∉": r"\notin", "⊂": r"\subset", "⊃": r"\supset", "∪": r"\cup", "∩": r"\cap", "→": r"\rightarrow", "←": r"\leftarrow",
    "⇒": r"\Rightarrow", "⇔": r"\Leftrightarrow", "∀": r"\forall", "∃": r"\exists", "∝": r"\propto",
}
LATEX_COMMANDS = (r"\frac", r"\sqrt", r"\sum", r"\int", r"\alpha", r"\beta", r"\gamma", r"\times", r"\div")
END_OPERATORS = "+-=×·÷/*<>≤≥≠≈([{,;:∈⊂∧∨"
START_OPERATORS = "^_)]}!×÷·*/=≠≈≤≥"
MODELS = [(1.0, "0.5B"), (2.0, "0.5B"), (3.0, "1.5B"), (4.0, "1.5B"), (6.0, "3B"), (8.0, "3B"), (12.0, "7B")]


def _any(d: Dialect, x: str, names: str) -> str:
    return f"{d.chars(x, names)} > 0"


ZONE_FONTS = ("math", "symbol", "stix", "cmmi")
#: Without one of these characters or words no pattern, density or proportion counts.
_ZONE_MARKS = ZONE_CHARS + "^_{}[]()/'*\\"
_TRIG, _LOG = "sen|cos|tan|cot|sec|csc|sin|arcsen|arccos|arctan", "log|ln|lg|exp"


def zone_gate(d: Dialect, t: str) -> str:
    """Whether a text has any character or word that a zone's marks need; plain prose has none."""
    return f"({d.chars(t, _ZONE_MARKS)} > 0 OR {d.has(t, word(f'{_TRIG}|{_LOG}|lim'), fold=True)} OR {d.has(t, f'[{ITALIC}]')})"


def zone_marks(d: Dialect, t: str, gate: str) -> dict[str, str]:
    """Named expressions that a zone's score is made of: density, the patterns, italic, isolated; false at once where gate is."""
    g = "a-zA-Z0-9" + GREEK_LOWER
    total = f"length(replace({t}, ' ', ''))"
    italic = d.count(t, f"[{ITALIC}]")
    ops = f"({d.chars(t, ZONE_CHARS + '*/^_()[]{}')})"
    isolated = f"{total} >= 3 AND coalesce({ops} * 1.0 / nullif({d.count(t, r'[\p{L}0-9]')} + {ops}, 0) BETWEEN 0.1 AND 0.6, FALSE)"
    patterns = {
        "fraction": d.has(t, rf"[{g}]+{S}*/{S}*[{g}]+"), "equation": d.has(t, rf"[{g}()]+{S}*[=<>≤≥≠]{S}*[{g}()]+"), "call": d.has(t, rf"(^|{NW})(f|g|h|y){S}*\({S}*[a-zA-Z]{S}*\){S}*="), "sqrt": d.has(t, r"√|\\sqrt"),
        "power": d.has(t, rf"[a-zA-Z0-9]{S}*[\^²³⁴⁵⁶⁷⁸⁹]"), "subscript": d.has(t, rf"[a-zA-Z]{S}*[₀₁₂₃₄₅₆₇₈₉ₐₑₒₓₙ]"), "sum_prod": d.has(t, "[∑∏∫]"), "limit": d.has(t, rf"(^|{NW})lim(_|{NW}|\z)"),
        "trig": d.has(t, word(_TRIG), fold=True), "log": d.has(t, word(_LOG), fold=True), "set_notation": d.has(t, r"[∈∉⊂⊃∩∪]|\\in|\\subset"), "derivative": d.has(t, rf"[a-zA-Z]'{S}*\(|d[a-zA-Z]/d[a-zA-Z]|∂"),
        "italic": f"{italic} > 0",
    }
    made = {f"z_{k}": f"CASE WHEN {gate} THEN {v} ELSE FALSE END" for k, v in (patterns | {"isolated": isolated}).items()}
    made["z_density"] = f"CASE WHEN {gate} THEN coalesce(({d.chars(t, ZONE_CHARS)} + {italic} + {d.chars(t, '^_{}[]()/')} * 0.5) / nullif({total}, 0), 0.0) ELSE 0.0 END"
    return made


#: What each mark counts, in thousandths; italic counts as a pattern and as a range.
ZONE_POINTS = {
    "fraction": 250, "equation": 300, "call": 350, "sqrt": 300, "power": 200, "subscript": 200, "sum_prod": 350, "limit": 300, "trig": 250, "log": 200, "set_notation": 250, "derivative": 300, "italic": 400, "isolated": 150,
}


def zones(d: Dialect, source: str, width: str = "612", least: int = 0) -> str:
    """The rows of source (text, font, x0, x1) with score in thousandths (uncapped), confidence (at most 1000), zone_type and hints.

    zone_type: display for what stands in the middle and fills less than 60 % of the page's width, else equation, fraction
    or inline. Rows below `least` are left out.
    """
    marked = d.once(d.once(source, z_gate=zone_gate(d, "text")), **zone_marks(d, "text", "z_gate"))
    centred = f"(abs((x0 + x1) / 2 - {width} / 2.0) < {width} * 0.15 AND x1 - x0 < {width} * 0.6)"
    fonts = "(" + " OR ".join(f"contains(lower(font), '{f}')" for f in ZONE_FONTS) + ")"
    terms = [(f"z_{k}", str(v)) for k, v in ZONE_POINTS.items()] + [(fonts, "300"), (centred, "100"), ("z_density >= 0.15", "CAST(floor(z_density * 400) AS INT)")]
    kind = f"CASE WHEN {centred} THEN 'display' WHEN z_equation THEN 'equation' WHEN z_fraction THEN 'fraction' ELSE 'inline' END"
    named = [("z_density >= 0.15", "math_density"), (fonts, "math_font"), *((f"z_{k}", f"pattern:{'function' if k == 'call' else k}") for k in ZONE_POINTS if k not in ("italic", "isolated"))]
    named += [("z_italic", "pattern:unicode_math"), (centred, "centered"), ("z_italic", "unicode_math_chars"), ("z_isolated", "isolated_expression")]
    hints = d.join(d.keep(d.array(*(f"CASE WHEN {c} THEN '{n}' ELSE '' END" for c, n in named)), "h", "h <> ''"), " ")
    own = ", ".join(f"CASE WHEN length(trim(text)) < 2 THEN {zero} ELSE {made} END AS {name}" for name, made, zero in (("score", d.total(terms), "0"), ("zone_type", kind, "'inline'"), ("hints", hints, "''")))
    scored = f"SELECT *, {own} FROM ({marked}) AS m"
    columns = "doc_id, page_num, block_idx, text, x0, x1"
    return f"SELECT {columns}, score, least(score, 1000) AS confidence, zone_type, hints FROM ({scored}) AS s WHERE score >= {least}"


def features(d: Dialect, t: str) -> dict[str, str]:
    """Counts and marks of a text as named expressions."""
    return {
        "math_symbols": d.chars(t, "∑∏∫∂∇√∛∞±×÷≤≥≠≈≡∝∈∉⊂⊃∪∩∀∃"), "greek": f"{d.chars(t, GREEK_LOWER + GREEK_UPPER)} + CASE WHEN {d.has(t, word(GREEK_WORDS), fold=True)} THEN 1 ELSE 0 END",
        "operators": d.chars(t, "+-*/=<>^"), "subscripts": d.chars(t, SUBSCRIPTS), "superscripts": d.chars(t, SUPERSCRIPTS), "parentheses": d.chars(t, "()[]{}"),
        "isolated": isolated_letters(d, t), "numbers": d.count(t, r"\d+([.,]\d+)?"), "has_equation": d.has(t, "[=≈≠]"), "has_fraction": d.has(t, rf"{W}+{S}*/{S}*{W}+"),
        "has_power": d.has(t, rf"{W}{S}*[\^²³⁴⁵⁶⁷⁸⁹]"), "has_function": d.has(t, word(FUNCTIONS), fold=True), "has_number": d.has(t, rf"\({S}*\d+\.\d+{S}*\)"), "n_chars": f"length({t})",
    }


def confidence_percent(d: Dialect) -> str:
    """Score 0 to 100 over the columns of features()."""
    part = lambda c, k, per: f"{k} * least(1.0, {c} / {per}.0)"
    terms = [
        ("n_chars > 200", "-30"), ("n_chars > 100 AND n_chars <= 200", "-15"), ("isolated >= CASE WHEN n_chars > 50 THEN 3 ELSE 2 END", part("isolated", 15, 6)),
        ("math_symbols >= 2", part("math_symbols", 25, 4)), ("greek >= 1", part("greek", 20, 2)), ("operators >= 2", part("operators", 10, 4)), ("subscripts >= 1", part("subscripts", 15, 2)),
        ("superscripts >= 1", part("superscripts", 15, 2)), ("has_equation AND n_chars < 100", "20"), ("has_fraction", "15"), ("has_power", "15"), ("has_function", "20"),
        ("has_number AND n_chars < 80", "25"),
    ]
    return f"CAST(round(greatest(0, least(100, {d.total(terms)})) * 100) AS INT)"


def confidence_class(score: str) -> str:
    """none, low, medium or high of a score in ten-thousandths."""
    return f"CASE WHEN {score} >= 7500 THEN 'high' WHEN {score} >= 5500 THEN 'medium' WHEN {score} >= 3500 THEN 'low' ELSE 'none' END"


def is_formula_line(d: Dialect, t: str) -> str:
    """Whether stripped text t scores 4 or more as a line of formula."""
    words = d.count(t, f"[^{S_IN}]+")
    special = GREEK_LOWER + GREEK_UPPER + "∑∏∫∂∇√∞∈∉⊂⊃∪∩∀∃"
    ops = "+-*/^=≠≈≤≥<>±×÷·"
    maths = f"({d.chars(t, ops + special + '()[]{}')} + {d.count(t, '[0-9]')})"
    score = (
        f"CASE WHEN contains({t}, '=') THEN 2 ELSE 0 END + least(3, {d.chars(t, ops)}) + least(2, {d.chars(t, special)}) + CASE WHEN {_any(d, t, '/^_')} THEN 1 ELSE 0 END"
        f" + CASE WHEN {maths} * 1.0 / greatest(1, length(replace({t}, ' ', ''))) > 0.3 THEN 2 ELSE 0 END - CASE WHEN {words} > 5 THEN 2 ELSE 0 END"
    )
    return f"(length({t}) >= 3 AND {score} >= 4)"


def is_math_expression(d: Dialect, t: str) -> str:
    return f"(length({t}) >= 2 AND ({_any(d, t, '=≠≈≤≥<>±×÷·+∑∏∫∂∇√∞∈∉⊂⊃∪∩∀∃' + GREEK_LOWER + GREEK_UPPER)} OR {d.has(t, rf'[a-zA-Z]{S}*={S}*[a-zA-Z0-9]')} OR contains({t}, '^') OR {d.has(t, r'_\d')} OR {d.has(t, f'{W}/{W}')}))"


def fragment_class(d: Dialect, t: str) -> str:
    """Class of a line as part of an expression."""
    return (
        f"CASE WHEN {t} = '' THEN 'unknown' WHEN {d.has(t, r'^[+\-*/=×÷·±<>≤≥≠≈]')} THEN 'operator_start' WHEN {d.has(t, rf'[+\-*/=×÷·±<>≤≥≠≈]{S}*\z')} THEN 'operator_end'"
        f" WHEN {d.has(t, r'^[_—–\-]{2,}\z')} THEN 'fraction_num' WHEN {d.has(t, r'^[A-Za-zα-ωΑ-Ω]\z')} THEN 'variable' WHEN {d.has(t, f'^[{SUBSCRIPTS}]+\\z')} THEN 'subscript'"
        f" WHEN {d.has(t, f'^[{SUPERSCRIPTS}]+\\z')} THEN 'superscript' WHEN contains({t}, '=') AND length({t}) > 3 THEN 'complete' ELSE 'continuation' END"
    )


def line_groups(d: Dialect, source: str, key: str = "doc_id", order: str = "block_idx", y: str = "10 * block_idx") -> str:
    """Adjacent lines that belong to one expression: key, grp, merged, n; gaps and islands over the pair rules (within 15 points)."""
    c = f"SELECT {key}, {order} AS o, text, {d.double(y)} AS y, {fragment_class(d, 'text')} AS cls FROM ({source}) AS s"
    w = f"OVER (PARTITION BY {key} ORDER BY o)"
    p = f"SELECT *, lag(cls) {w} AS cls0, lag(y) {w} AS y0 FROM ({c}) AS c"
    rule = "(cls0 = 'operator_end' OR cls = 'operator_start' OR (cls0 = 'variable' AND cls IN ('subscript', 'superscript')) OR (cls0 = 'continuation' AND cls = 'continuation' AND abs(y - y0) < 5))"
    g = f"SELECT *, sum(CASE WHEN coalesce(abs(y - y0) <= 15 AND {rule}, FALSE) THEN 0 ELSE 1 END) {w} AS grp FROM ({p}) AS p"
    return f"SELECT {key}, grp, count(*) AS n, {d.gather('text', 'o', d.lit(' '))} AS merged FROM ({g}) AS g GROUP BY {key}, grp"


def unbalanced(d: Dialect, t: str) -> str:
    """Unequal counts of opening and closing marks, \\left and \\right, \\begin and \\end."""
    return f"({d.chars(t, '([{')} <> {d.chars(t, ')]}')} OR {d.times(t, chr(92) + 'left')} <> {d.times(t, chr(92) + 'right')} OR {d.count(t, r'\\begin\{[^}]+\}')} <> {d.count(t, r'\\end\{[^}]+\}')})"


def ends_open(d: Dialect, t: str) -> str:
    """Ends with an operator or an opening mark."""
    return f"(({t} <> '' AND instr({d.lit(END_OPERATORS)}, {d.last(t)}) > 0) OR {d.has(t, r'\\left\(?\z')})"


def starts_closing(d: Dialect, t: str) -> str:
    """Starts with what continues an expression; + and - don't."""
    return f"({t} <> '' AND instr({d.lit(START_OPERATORS)}, {d.first(t)}) > 0)"


def to_latex(d: Dialect, x: str) -> str:
    """Characters as LaTeX: runs of super- and subscripts in one pair of braces, roots, then single characters."""
    sup, sub = f"[{SUPERSCRIPTS}]", f"[{SUBSCRIPTS}]"
    x = d.sub(x, f"({sup}+)", r"^{\1}")
    x = f"translate({x}, {d.lit(SUPERSCRIPTS)}, {d.lit(SUPER_PLAIN)})"
    x = d.sub(x, f"({sub}+)", r"_{\1}")
    x = f"translate({x}, {d.lit(SUBSCRIPTS)}, {d.lit(SUB_PLAIN)})"
    for mark, head in (("√", r"\sqrt"), ("∛", r"\sqrt[3]")):
        x = d.sub(x, rf"{mark}\(([^)]*)\)", head + r"{\1}")
        x = d.sub(x, rf"{mark}([\p{{L}}\p{{N}}]+)", head + r"{\1}")
    for c, tex in LATEX.items():
        x = f"replace({x}, {d.lit(c)}, {d.lit(tex)})"
    return x


def is_latex(d: Dialect, x: str) -> str:
    return f"(({d.first(x)} = '$' AND {d.last(x)} = '$') OR " + " OR ".join(f"contains({x}, {d.lit(c)})" for c in LATEX_COMMANDS) + ")"


def needs_latex(d: Dialect, x: str) -> str:
    return f"(NOT {is_latex(d, x)} AND {_any(d, x, ''.join(LATEX) + SUPERSCRIPTS + SUBSCRIPTS + '√∛')})"


def wrapped(d: Dialect, x: str) -> str:
    """In $..$, or on lines of its own between $$ where longer than 40 characters."""
    return f"CASE WHEN length({x}) > 40 THEN concat('$$', {d.newline()}, {x}, {d.newline()}, '$$') ELSE concat('$', {x}, '$') END"


def inline_formula(d: Dialect, x: str) -> str:
    return f"({_any(d, x, '𝑓𝑔𝑥𝑦𝑧𝑎𝑏𝑐𝑛𝑚𝑘𝐴𝐵𝐶√∫∑∏' + GREEK_LOWER + GREEK_UPPER)} OR {d.has(x, rf'ƒ{S}*\([^)]+\)')})"


def plain_scripts(d: Dialect, x: str) -> str:
    """The fallback converter: each super- or subscript character on its own."""
    for names, plain, mark in ((SUPERSCRIPTS, SUPER_PLAIN, "^"), (SUBSCRIPTS, SUB_PLAIN, "_")):
        for a, b in zip(names, plain):
            x = f"replace({x}, {d.lit(a)}, {d.lit(f'{mark}{{{b}}}')})"
    return x


def model_for_memory(d: Dialect, memory: str) -> str:
    """The largest model whose threshold is not above the memory; the smallest below all thresholds."""
    return "CASE " + " ".join(f"WHEN {memory} >= {t} THEN {d.lit(m)}" for t, m in reversed(MODELS)) + f" ELSE {d.lit(MODELS[0][1])} END"


def merged_regions(source: str) -> str:
    """Intervals (grp, s, e, conf) united where they touch: running maximum of ends, then islands."""
    r = f"SELECT *, max(e) OVER (PARTITION BY grp ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM ({source}) AS a"
    i = f"SELECT *, sum(CASE WHEN s <= upto THEN 0 ELSE 1 END) OVER (PARTITION BY grp ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM ({r}) AS b"
    return f"SELECT grp, min(s) AS s, max(e) AS e, max(conf) AS conf FROM ({i}) AS c GROUP BY grp, island"


# Words and signs that a formula's text is spelled with.
TEXT_LATEX = {w: "\\" + w for w in "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau upsilon phi chi psi omega".split()}
TEXT_FUNCTIONS = {"sen": r"\sin", "cos": r"\cos", "tan": r"\tan", "tg": r"\tan", "log": r"\log", "ln": r"\ln", "exp": r"\exp", "lim": r"\lim", "max": r"\max", "min": r"\min"}
TEXT_SIGNS = {c: LATEX[c] for c in "∞∑∏∫∂∇±×÷≤≥≠≈∈∉⊂⊃∪∩→←"} | {"√": r"\sqrt", "↔": r"\leftrightarrow"}
_OPEN, _SHUT = "\ufdd0", "\ufdd1"  # fences: code points that no text holds


def text_latex(d: Dialect, x: str) -> str:
    """Text as LaTeX: names of letters (capitalised names as capitals) and functions, signs, scripts one by one, fractions
    of numbers or single letters, powers and indices in braces."""
    x = d.sub(x, f"({W}+)", rf"{_OPEN}\1{_SHUT}")
    for w, t in (TEXT_LATEX | {w.capitalize(): "\\" + w.capitalize() for w in TEXT_LATEX} | TEXT_FUNCTIONS).items():
        x = f"replace({x}, {d.lit(_OPEN + w + _SHUT)}, {d.lit(t)})"
    x = f"translate({x}, {d.lit(_OPEN + _SHUT)}, '')"
    for c, t in TEXT_SIGNS.items():
        x = f"replace({x}, {d.lit(c)}, {d.lit(t)})"
    for names, mark in (("₀₁₂₃₄₅₆₇₈₉", "_"), ("⁰¹²³⁴⁵⁶⁷⁸⁹", "^")):
        for k, c in enumerate(names):
            x = f"replace({x}, {d.lit(c)}, {d.lit(f'{mark}{{{k}}}')})"
    x = d.sub(x, rf"([0-9]+|{W}){S}*/{S}*([0-9]+|{W})", r"\frac{\1}{\2}")
    return d.sub(d.sub(x, r"\^([0-9]+)", r"^{\1}"), r"_([0-9]+)", r"_{\1}")


def equation_block(d: Dialect, latex: str, label: str) -> str:
    """An equation between $$, its number (null: none) behind it."""
    return f"CASE WHEN {label} IS NULL THEN concat('$$', {latex}, '$$') ELSE concat('$$', {latex}, {d.lit(' ' + chr(92) + 'quad (')}, {label}, ')$$') END"


def joined_fragments(d: Dialect, text: str, n: str) -> str:
    """A formula of n fragments joined by spaces: as variable = expression, or as a fraction, where it reads so."""
    equation, over = rf"([A-Za-z_]{W}*){S}*[=:]{S}*([^\n]+)", rf"([^{S_IN}]+){S}*[/÷]{S}*([^{S_IN}]+)"
    side = lambda k: d.group(text, over, k)
    return (
        f"CASE WHEN {n} <= 1 THEN {text} WHEN {d.has(text, equation)} THEN concat({d.group(text, equation, 1)}, ' = ', {d.strip(d.group(text, equation, 2))})"
        f" WHEN {d.has(text, over)} THEN concat({d.lit(chr(92) + 'frac{')}, {side(1)}, '}}{{', {side(2)}, '}}') ELSE {text} END"
    )
