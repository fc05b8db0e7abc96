"""Formulas that extraction broke over lines, put together again: passes over the lines of a text.

Every pass reads left to right and takes one to three lines at a time, so what a line becomes can depend on what the
pass made of the lines before it; a text is one sequential pass, texts are independent.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from leafwork.functions.dialect import Dialect, S
from leafwork.operators.formulas import fragment_class
from leafwork.operators.notation import LOWER, OPERATORS, PLAIN_LOWER, PLAIN_UPPER, UPPER, python_column

# Characters and patterns.

SIGNS = "+-×÷·=≠≈<>≤≥"
LETTERS = LOWER + UPPER
SYMBOLS = "∞∑∫∂√≤≥≠≈∈∉⊂⊃∩∪→←↔⇒⇐⇔±×÷·∝∀∃∇∆"
SMALL_UP = "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻ⁿⁱ"
SIDE = re.compile(rf"^\s*[a-zA-Z0-9{LOWER}+\-*()]+\s*$")
BAR = re.compile(r"^\s*[─━—–\-_]{2,}\s*$")
EXPONENT = re.compile(r"^\s*[0-9n²³⁴⁵⁶⁷⁸⁹⁺⁻]\s*$")
INDEX = re.compile(r"^\s*[0-9₀₁₂₃₄₅₆₇₈₉ₐₑₒₓₙ]\s*$")
SIGN = re.compile(r"^\s*[+\-×÷·=]\s*$|^\s*[+\-×÷·=]\s+|\s+[+\-×÷·=]\s*$")
DEFINES = re.compile(r"\bsendo\s*$|\bonde\s*$|\bcom\s*$", re.IGNORECASE | re.MULTILINE)
RAISED = dict(zip("0123456789n+-", "⁰¹²³⁴⁵⁶⁷⁸⁹ⁿ⁺⁻"))
LOWERED = dict(zip("0123456789naeox", "₀₁₂₃₄₅₆₇₈₉ₙₐₑₒₓ"))

Rule = Callable[[list[str], int, list[str]], "tuple[list[str], int] | None"]


def consume(lines: list[str], rule: Rule) -> list[str]:
    """Left to right: rule(lines, i, what is done) gives the new lines and how many old ones they stand for, or None."""
    out, i = [], 0
    while i < len(lines):
        new, used = rule(lines, i, out) or ([lines[i]], 1)
        out += new
        i += used
    return out


def _any(text: str, names: str) -> bool:
    return any(c in names for c in text)


def like_expression(text: str) -> bool:
    """A mathematical character, a short fraction, a sign, or at most three characters that start with a letter."""
    return bool(text) and (_any(text, LETTERS + SYMBOLS) or _any(text, "+-*/^_=") or (len(text) <= 3 and text[0].isalpha()))


def fraction_score(above: str, bar: str, below: str) -> float:
    """How sure it is that three lines are a fraction; 0 where the middle is no bar or a side is missing."""
    above, below = above.strip(), below.strip()
    if not BAR.match(bar) or not above or not below:
        return 0.0
    score = 0.4 + 0.3 * bool(SIDE.match(above)) + 0.3 * bool(SIDE.match(below)) + 0.1 * _any(above + below, LETTERS + SYMBOLS)
    score -= 0.3 * (max(len(above), len(below)) > 30) + 0.4 * (max(len(above.split()), len(below.split())) > 3)
    return max(0.0, min(1.0, score))


def _fraction(lines, i, out):
    if i + 2 >= len(lines) or fraction_score(*lines[i : i + 3]) < 0.6:
        return None
    above, below = lines[i].strip(), lines[i + 2].strip()
    return [f"({above})/({below})" if _any(above + below, "+-") else f"{above}/{below}"], 3


def _equation(lines, i, out):
    if i + 1 >= len(lines):
        return None
    own, nxt = lines[i].strip(), lines[i + 1].strip()
    goes_on = own.endswith("=") and like_expression(nxt) or DEFINES.search(own) and nxt
    return ([f"{own} {nxt}"], 2) if goes_on else None


def is_orphan(text: str) -> bool:
    """At most ten characters that are, start or end with a sign, or one digit, script or letter."""
    own = text.strip()
    return 0 < len(text) <= 10 and bool(SIGN.match(own) or EXPONENT.match(own) or INDEX.match(own) or (len(own) == 1 and own.isalpha()))


def _orphan(lines, i, out):
    own = lines[i].strip()
    if not is_orphan(own):
        return None
    before = out[-1].strip() if out else ""
    alone = len(own) == 1
    if before and (before[-1] in SIGNS or own[0] in SIGNS or (before[-1].isalnum() and alone and own in SMALL_UP)):
        out[-1] = f"{out[-1]} {own}"
        return [], 1
    nxt = lines[i + 1].strip() if i + 1 < len(lines) else ""
    return ([f"{own} {nxt}"], 2) if nxt and alone and own in SIGNS and like_expression(nxt) else None


def _script(pattern: re.Pattern, names: dict[str, str], mark: str, base: Callable[[str], bool]) -> Rule:
    def rule(lines, i, out):
        if i + 1 >= len(lines):
            return None
        own, nxt = lines[i].strip(), lines[i + 1].strip()
        if not own or not pattern.match(nxt) or not base(own[-1]):
            return None
        return [own + names.get(nxt, mark + nxt)], 2

    return rule


PASSES: dict[str, tuple[Rule, int]] = {
    "fractions": (_fraction, 3), "equations": (_equation, 2), "orphans": (_orphan, 2), "exponents": (_script(EXPONENT, RAISED, "^", str.isalnum), 2), "indices": (_script(INDEX, LOWERED, "_", str.isalpha), 2),
}


def rebuild(text: str | None, passes: tuple[str, ...] = tuple(PASSES)) -> str | None:
    """The text after the named passes, in their order: vertical fractions, equations that go on after =, stray signs,
    digits that are exponents of the line before, digits that are indices."""
    if not text:
        return text
    lines = text.split("\n")
    for name, (rule, least) in PASSES.items():
        if name in passes and len(lines) >= least:
            lines = consume(lines, rule)
    return "\n".join(lines)


def fraction_lines(lines: list[str]) -> list[str]:
    return rebuild("\n".join(lines), ("fractions",)).split("\n")


def equation_lines(lines: list[str]) -> list[str]:
    return rebuild("\n".join(lines), ("equations", "orphans")).split("\n")


def with_rebuilt(df: DataFrame, source: str = "text", out: str = "rebuilt") -> DataFrame:
    """Adds out, the texts with broken formulas joined. Null stays null."""
    return df.withColumn(out, F.coalesce(python_column(df, source, rebuild, "string"), F.col(source)))


def line_fragments(d: Dialect, source: str) -> str:
    """doc_id, block_idx, text, kind, confidence (hundredths), context of stripped lines, blank ones among them, that look like a part of a formula.

    kind: fraction_line, exponent, subscript, operator or variable, the first that fits; context: the line and the two
    before and after it, those that aren't blank, between bars.
    """
    t = "text"
    kind = (
        f"CASE WHEN {d.has(t, r'^[─━—–_\-]{2,}\z')} THEN 'fraction_line' WHEN {d.has(t, r'^[0-9n²³⁴⁵⁶⁷⁸⁹⁺⁻]\z')} THEN 'exponent' WHEN {d.has(t, r'^[0-9₀₁₂₃₄₅₆₇₈₉ₐₑₒₓₙ]\z')} THEN 'subscript'"
        f" WHEN {d.has(t, rf'^[+\-×÷·=]({S}|\z)')} THEN 'operator' WHEN length({t}) <= 2 AND {d.has(t, r'^\p{L}')} THEN 'variable' END"
    )
    w = "OVER (PARTITION BY doc_id ORDER BY block_idx)"
    around = ", ".join(f"nullif({f}(text, {k}) {w}, '') AS {n}" for f, k, n in (("lag", 2, "b2"), ("lag", 1, "b1"), ("lead", 1, "a1"), ("lead", 2, "a2")))
    named = d.once(f"SELECT *, {around} FROM ({source}) AS s", kind=kind)
    sure = "CASE kind WHEN 'fraction_line' THEN 90 WHEN 'operator' THEN 80 WHEN 'variable' THEN 50 ELSE 70 END"
    return f"SELECT doc_id, block_idx, text, kind, {sure} AS confidence, concat_ws(' | ', b2, b1, text, a1, a2) AS context FROM ({named}) AS n WHERE kind IS NOT NULL"


# What a rebuilt line's characters are in LaTeX, scripts one by one.
TEX = PLAIN_LOWER | PLAIN_UPPER | {c: OPERATORS[c] for c in "∞∑∏∫∂∇√±∓×÷·≤≥≠≈≡∝∈∉⊂⊃∪∩∧∨¬←↔⇒⇐∀∃∅"} | {"→": r"\rightarrow"}
del TEX["Υ"]
SCRIPTS = {c: f"_{n}" for c, n in zip("₀₁₂₃₄₅₆₇₈₉", "0123456789")} | {c: f"^{n}" for c, n in zip("⁰¹²³⁴⁵⁶⁷⁸⁹ⁿⁱ", "0123456789ni")}


def normalised(d: Dialect, x: str) -> str:
    """One space around signs and between words, none around."""
    return d.strip(d.sub(d.sub(d.sub(x, rf"{S}{{2,}}", " "), rf"{S}*([+\-×÷·=]){S}*", r" \1 "), rf"{S}{{2,}}", " "))


def group_latex(d: Dialect, x: str) -> str:
    for c, t in (TEX | SCRIPTS).items():
        x = f"replace({x}, {d.lit(c)}, {d.lit(t)})"
    return x


def line_groups(d: Dialect, source: str) -> str:
    """doc_id, text, latex, confidence (ten-thousandths), method: a document's fragments as one expression.

    Neighbours that belong together are one part (scripts without a space); a part of several lines counts 0.8, of one
    0.9, a single complete line 0.95.
    """
    c = f"SELECT doc_id, block_idx, text, {d.double('10 * block_idx')} AS y, {fragment_class(d, 'text')} AS cls FROM ({source}) AS s"
    w = "OVER (PARTITION BY doc_id ORDER BY block_idx)"
    p = f"SELECT *, lag(cls) {w} AS cls0, lag(y) {w} AS y0 FROM ({c}) AS c"
    rule = "(cls0 = 'operator_end' OR cls = 'operator_start' OR (cls0 = 'variable' AND cls IN ('subscript', 'superscript')) OR (cls0 = 'continuation' AND cls = 'continuation' AND abs(y - y0) < 5))"
    g = f"SELECT *, sum(CASE WHEN coalesce(abs(y - y0) <= 15 AND {rule}, FALSE) THEN 0 ELSE 1 END) {w} AS grp FROM ({p}) AS p"
    glued = f"SELECT *, CASE WHEN row_number() OVER (PARTITION BY doc_id, grp ORDER BY block_idx) = 1 OR cls IN ('subscript', 'superscript') THEN text ELSE concat(' ', text) END AS piece FROM ({g}) AS g"
    parts = f"SELECT doc_id, grp, count(*) AS n, min(cls) AS cls, {d.gather('piece', 'block_idx', d.lit(''))} AS part FROM ({glued}) AS h GROUP BY doc_id, grp"
    whole = f"SELECT doc_id, sum(n) AS n, count(*) AS parts, sum(CASE WHEN n > 1 THEN 8000 ELSE 9000 END) AS points, min(cls) AS cls, {d.gather('part', 'grp', d.lit(' '))} AS joined FROM ({parts}) AS q GROUP BY doc_id"
    single = "n = 1 AND cls = 'complete'"
    shown = f"SELECT *, CASE WHEN {single} THEN joined ELSE {normalised(d, 'joined')} END AS text FROM ({whole}) AS w"
    return f"SELECT doc_id, text, {group_latex(d, 'text')} AS latex, CASE WHEN {single} THEN 9500 ELSE CAST(floor(points / parts) AS BIGINT) END AS confidence, CASE WHEN {single} THEN 'single_complete' ELSE 'heuristic_grouping' END AS method FROM ({shown}) AS t"
