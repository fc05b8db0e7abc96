"""Characters of mathematical notation and what they are in LaTeX, for the operators that read matches in Python."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from leafwork.session import ship

# Greek letters by name in alphabetical order, as capitals, and their variants.
LOWER = "αβγδεζηθικλμνξοπρστυφχψω"
UPPER = "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"
NAMES = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi o pi rho sigma tau upsilon phi chi psi omega".split()
CAPITALS = r"A B \Gamma \Delta E Z H \Theta I K \Lambda M N \Xi O \Pi P \Sigma T \Upsilon \Phi X \Psi \Omega".split()
VARIANTS = {"ϵ": r"\epsilon", "ϕ": r"\phi", "ϖ": r"\varpi", "ϱ": r"\varrho", "ς": r"\varsigma", "ϑ": r"\vartheta"}

#: Plain names; and the names in which ε and φ are the variants, with letters that look Latin as Latin ones.
PLAIN_LOWER = {c: "\\" + n for c, n in zip(LOWER, NAMES) if n != "o"}
PLAIN_UPPER = {c: n for c, n in zip(UPPER, CAPITALS) if len(n) > 1}
GREEK = {c: "o" if n == "o" else "\\" + {"epsilon": "varepsilon", "phi": "varphi"}.get(n, n) for c, n in zip(LOWER, NAMES)} | VARIANTS | dict(zip(UPPER, CAPITALS))

# Operators and marks.
OPERATORS = {
    "×": r"\times", "÷": r"\div", "·": r"\cdot", "±": r"\pm", "∓": r"\mp", "≠": r"\neq", "≈": r"\approx", "≡": r"\equiv", "≅": r"\cong", "≤": r"\leq", "≥": r"\geq", "≪": r"\ll", "≫": r"\gg",
    "∞": r"\infty", "∝": r"\propto", "∼": r"\sim", "≃": r"\simeq", "∑": r"\sum", "∏": r"\prod", "∫": r"\int", "∬": r"\iint", "∭": r"\iiint", "∮": r"\oint", "∂": r"\partial", "∇": r"\nabla",
    "√": r"\sqrt", "∛": r"\sqrt[3]", "∜": r"\sqrt[4]", "∈": r"\in", "∉": r"\notin", "∋": r"\ni", "∌": r"\notni", "⊂": r"\subset", "⊃": r"\supset", "⊆": r"\subseteq", "⊇": r"\supseteq",
    "∩": r"\cap", "∪": r"\cup", "∅": r"\emptyset", "∖": r"\setminus", "∀": r"\forall", "∃": r"\exists", "∄": r"\nexists", "∧": r"\land", "∨": r"\lor", "¬": r"\neg", "⊕": r"\oplus", "⊗": r"\otimes",
    "→": r"\to", "←": r"\leftarrow", "↔": r"\leftrightarrow", "⇒": r"\Rightarrow", "⇐": r"\Leftarrow", "⇔": r"\Leftrightarrow", "↑": r"\uparrow", "↓": r"\downarrow", "↕": r"\updownarrow",
    "⇑": r"\Uparrow", "⇓": r"\Downarrow", "↦": r"\mapsto", "↪": r"\hookrightarrow", "°": r"^\circ", "′": "'", "″": "''", "‴": "'''", "∠": r"\angle", "⊥": r"\perp", "∥": r"\parallel",
    "•": r"\bullet", "⋯": r"\cdots", "⋮": r"\vdots", "⋱": r"\ddots", "⟨": r"\langle", "⟩": r"\rangle", "⌈": r"\lceil", "⌉": r"\rceil", "⌊": r"\lfloor", "⌋": r"\rfloor", "‖": r"\|",
}
#: Those that detected spans know.
SPAN_OPERATORS = {c: t for c, t in OPERATORS.items() if c not in "∌⊕⊗↕⇑⇓↦↪‴•⋯⋮⋱⌈⌉⌊⌋‖"}
SUPERSCRIPTS = dict(zip("⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿⁱ", "0123456789+-=()ni"))
SUBSCRIPTS = dict(zip("₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎ₐₑₒₓₕₖₗₘₙₚₛₜ", "0123456789+-=()aeoxhklmnpst"))
#: Letters and digits of the mathematical alphabets (italic, bold) by rule: each block runs from A, a or 0.
ALPHABETS = {chr(first + k): chr(ord(plain) + k) for first, plain, n in ((0x1D44E, "a", 26), (0x1D434, "A", 26), (0x1D41A, "a", 26), (0x1D400, "A", 26), (0x1D7CE, "0", 10)) for k in range(n)}
CHARACTERS = GREEK | OPERATORS | ALPHABETS

# Function names, and those that LaTeX has commands for.
FUNCTIONS = "sin cos tan cot sec csc arcsin arccos arctan arccot sinh cosh tanh coth sen log ln lg exp lim max min sup inf det dim ker Im Re gcd lcm mod".split()
COMMANDS = set("sin cos tan cot sec csc log ln exp lim max min det dim ker gcd mod sinh cosh tanh coth arcsin arccos arctan".split())

_SIDE = rf"(\([^)]+\)|[a-zA-Z0-9{LOWER}]+)"
_FRACTION = re.compile(rf"{_SIDE}\s*/\s*{_SIDE}")
_CALL = re.compile(r"\b(" + "|".join(sorted(FUNCTIONS, key=len, reverse=True)) + r")(?=\s*[(\[])", re.IGNORECASE)
_RUNS = {mark: (re.compile(f"[{''.join(names)}]+"), names) for mark, names in (("^", SUPERSCRIPTS), ("_", SUBSCRIPTS))}


def longest_first(names) -> str:
    """An alternation in which no name hides a longer one."""
    return "|".join(sorted(names, key=lambda n: (-len(n), n)))


def spelled(text: str) -> str:
    """Characters with a LaTeX name by that name."""
    return "".join(CHARACTERS.get(c, c) for c in text)


def _roots(text: str) -> str:
    for mark, head in (("√", r"\sqrt"), ("∛", r"\sqrt[3]"), ("∜", r"\sqrt[4]")):
        for inside in (r"\(([^)]+)\)", "([a-zA-Z0-9])"):
            text = re.sub(rf"{mark}\s*{inside}", lambda m: f"{head}{{{m[1]}}}", text)
    return text


def _fraction(m: re.Match, inline: bool) -> str:
    above, below = m[1], m[2]
    if inline and max(len(above), len(below)) <= 3 and "(" not in above + below:
        return f"{spelled(above)}/{spelled(below)}"
    bare = [x[1:-1] if x[0] == "(" and x[-1] == ")" else x for x in (above, below)]
    return "\\frac" + "".join(f"{{{spelled(x)}}}" for x in bare)


def _call(m: re.Match) -> str:
    name = next(f for f in FUNCTIONS if f.lower() == m[1].lower())
    return "\\" + name if name in COMMANDS else rf"\operatorname{{{name}}}"


def to_latex(text: str | None, style: str = "inline", long: int = 40) -> str | None:
    """The whole text as LaTeX; style: inline ($..$; over `long` characters $$..$$), display or raw. Blank text stays.

    Roots come first, then runs of super- and subscripts, fractions (inline, short sides stay a/b), single characters
    and function names.
    """
    if not text or not text.strip():
        return text
    style = "display" if style == "inline" and len(text) > long else style
    out = _roots(text)
    for mark, (run, names) in _RUNS.items():
        out = run.sub(lambda m: f"{mark}{{{''.join(names[c] for c in m[0])}}}", out)
    out = _FRACTION.sub(lambda m: _fraction(m, style == "inline"), out)
    out = re.sub(r"\s+", " ", _CALL.sub(_call, spelled(out))).strip()
    if style == "raw":
        return out
    fence = "$" if style == "inline" else "$$"
    out = re.sub(r"\$\$\$+", "$$", f"{fence}{out}{fence}")
    return out if out.startswith("$$") else re.sub(r"\$\s*\$", "", out)


def latex_character(c: str) -> str:
    """One character as LaTeX; characters of the mathematical alphabets and others stay."""
    for names, show in ((GREEK, "{}"), (OPERATORS, "{}"), (SUPERSCRIPTS, "^{{{}}}"), (SUBSCRIPTS, "_{{{}}}")):
        if c in names:
            return show.format(names[c])
    return c


def needs_latex(text: str | None) -> bool:
    """Whether a character has a LaTeX form, or two sides are divided."""
    return bool(text) and (any(c in GREEK or c in OPERATORS or c in SUPERSCRIPTS or c in SUBSCRIPTS for c in text) or bool(_FRACTION.search(text)))


def python_column(df: DataFrame, source: str, make: Callable, kind: str, gate: str | None = None):
    """A column of make(source) by Arrow batches; gate is SQL, and make sees null where it doesn't hold, at no cost."""
    ship(df.sparkSession)
    value = F.col(source) if gate is None else F.when(F.expr(gate), F.col(source))
    return F.udf(make, kind, useArrow=True)(value)


def texts_to_latex(df: DataFrame, source: str = "text", out: str = "latex", style: str = "inline") -> DataFrame:
    """Adds out, the source column as LaTeX; null stays null."""
    return df.withColumn(out, python_column(df, source, lambda t: to_latex(t, style), "string"))
