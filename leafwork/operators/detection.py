"""Formulas within a text: equations, fractions, powers, functions, Greek letters, chemical formulas, and their LaTeX."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from leafwork.functions.dialect import Dialect, S
from leafwork.operators.notation import LOWER, OPERATORS, PLAIN_LOWER, PLAIN_UPPER, UPPER, longest_first, python_column

# Signs, special characters, function names, elements, everyday words, units that look like fractions.
SIGNS = "+-×÷·±∓=≠≈≡≤≥<>∞∑∏∫∂∇√∝∈∉⊂⊃∩∪∧∨¬→←↔⇒⇐⇔"
SPECIAL = LOWER.replace("ο", "") + UPPER.replace("Ο", "") + "∀∃∄∅∆∇∈∉∋∌"
NAMES = "sin cos tan cot sec csc arcsin arccos arctan sinh cosh tanh log ln exp lim max min sup inf det dim ker deg gcd lcm mod sen tg cotg cossec".split()
ELEMENTS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe"
    " Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn"
).split()
EVERYDAY = {"de", "da", "do", "em", "para", "com", "que", "the", "and", "or", "is", "are"}
UNITS = {"e/ou", "km/h", "m/s", "kg/m", "n/a", "a/c", "c/c", "s/n", "i/o", "w/o", "b/w", "r/w"}
TEX = PLAIN_LOWER | PLAIN_UPPER | {c: OPERATORS[c] for c in "×÷·±∓≠≈≡≤≥∞∑∏∫∂∇√∝∈∉⊂⊃∩∪∅∧∨¬←↔⇒⇐⇔∀∃"} | {"→": r"\rightarrow"}

# The patterns.
_GK = "α-ωΑ-Ω"
EQUATION = re.compile(
    rf"(?<![a-zA-Z])([a-zA-Z{_GK}][a-zA-Z0-9{_GK}_\^\{{\}}]*(?:\s*[\+\-\*\/×÷·]\s*[a-zA-Z{_GK}0-9_\^\{{\}}\(\)]+)*)\s*=\s*([a-zA-Z{_GK}0-9_\^\{{\}}\(\)\+\-\*\/×÷·\s]+)"
)
FRACTION = re.compile(r"(?<![a-zA-Z])(\([^)]+\)|[a-zA-Z0-9]+)\s*/\s*(\([^)]+\)|[a-zA-Z0-9]+)(?![a-zA-Z])")
POWER = re.compile(r"([a-zA-Z0-9\)]+)\s*\^\s*(\{[^}]+\}|[a-zA-Z0-9]+|\([^)]+\))")
INDEX = re.compile(r"([a-zA-Z0-9]+)\s*_\s*(\{[^}]+\}|[a-zA-Z0-9]+)")
FUNCTION = re.compile(rf"\b({longest_first(NAMES)})\s*(?:_\s*(\{{[^}}]+\}}|[a-zA-Z0-9]+))?\s*[\(\[]([^\)\]]+)[\)\]]", re.IGNORECASE)
SYMBOL = re.compile(rf"([{_GK}])(?:\s*=\s*([0-9.,]+))?")
CHEMICAL = re.compile(rf"(\d*)\s*({longest_first(ELEMENTS)})(\d+)?(?:\(([A-Z][a-z]?)(\d+)?\)(\d+)?)*")


class Formula(NamedTuple):
    start: int
    end: int
    original: str
    latex: str
    block: bool
    confidence: float


def tex(text: str) -> str:
    """Characters by their commands, 2x as 2 x, x2 as x^{2}, single spaces."""
    text = "".join(TEX.get(c, c) for c in text)
    text = re.sub(r"([a-zA-Z])(\d+)(?!\})", r"\1^{\2}", re.sub(r"(\d)([a-zA-Z])", r"\1 \2", text))
    return re.sub(r"\s+", " ", text).strip()


def _bare(text: str) -> str:
    return text[1:-1] if text[0] == "{" and text[-1] == "}" else text


def equation_confidence(text: str) -> float:
    signs, special = sum(c in text for c in SIGNS), sum(c in SPECIAL for c in text)
    score = 0.3 * ("=" in text) + min(0.3, 0.1 * signs) + min(0.2, 0.1 * special) + 0.1 * bool(re.search(r"\b[a-zA-Z](?:\d+|_\d+)?\b", text))
    return max(0.0, min(1.0, score - 0.15 * sum(w.lower() in EVERYDAY for w in text.split())))


def fraction_confidence(above: str, below: str) -> float:
    plain = re.compile(r"^[\d\w\(\)\+\-]+$")
    return min(1.0, 0.5 + 0.3 * bool(plain.match(above) and plain.match(below)) + 0.1 * below.isdigit())


def chemical_confidence(text: str) -> float:
    known = sum(e in text for e in ELEMENTS)
    return min(1.0, 0.4 * bool(re.search(r"\d", text)) + 0.2 * ("(" in text and ")" in text) + 0.2 * bool(re.match(r"\d", text)) + min(0.3, 0.15 * known) + 0.1 * bool(re.search("[A-Z][a-z]", text)))


def chemical_tex(text: str) -> str:
    text = re.sub(r"([A-Za-z])(\d+)", r"\1_{\2}", re.sub(r"([A-Za-z])\(\s*([A-Za-z]+)\s*(\d+)\)", r"\1(_{\2})_{\3}", text))
    return re.sub(r"^(\d+)\s+", r"\1 ", text) if re.match(r"\d+\s*[A-Z]", text) else text


def _equation(m):
    own = m[0].strip()
    return (own, tex(own), len(own) > 50, equation_confidence(own)) if 3 <= len(own) <= 500 else None


def _fraction(m):
    return None if m[0].lower() in UNITS else (m[0], f"\\frac{{{tex(m[1])}}}{{{tex(m[2])}}}", False, fraction_confidence(m[1], m[2]))


def _power(m):
    own = _bare(m[2])
    return m[0], f"{tex(m[1])}^{{{tex(own)}}}", False, 0.8 if len(own) <= 3 else 0.6


def _index(m):
    return m[0], f"{tex(m[1])}_{{{tex(_bare(m[2]))}}}", False, 0.7


def _function(m):
    base = f"_{{{m[2].strip('{}')}}}" if m[2] else ""
    return m[0], f"\\{m[1].lower()}{base}({tex(m[3])})", False, 0.9


def _symbol(m):
    return (m[0], TEX[m[1]] + (f" = {m[2]}" if m[2] else ""), False, 0.8) if m[1] in TEX else None


def _chemical(m):
    own = m[0].strip()
    if len(own) < 2 or not (re.search(r"\d", own) or sum(e in own for e in ELEMENTS) >= 2):
        return None
    return own, chemical_tex(own), False, chemical_confidence(own)


#: (pattern, reading of a match, whether it must be sure before overlaps are resolved) in order of preference.
READINGS = [
    (EQUATION, _equation, True), (FRACTION, _fraction, False), (POWER, _power, False), (INDEX, _index, False), (FUNCTION, _function, False), (SYMBOL, _symbol, False), (CHEMICAL, _chemical, True),
]


def find_formulas(text: str | None, least: float = 0.5) -> list[Formula]:
    """The formulas of a text in order, none overlapping: the first by start, replaced by a surer one that meets it."""
    if not text or len(text) < 3:
        return []
    found = []
    for pattern, read, sure in READINGS:
        for m in pattern.finditer(text):
            got = read(m)
            if got and (not sure or got[-1] >= least):
                found.append(Formula(m.start(), m.end(), *got))
    kept: list[Formula] = []
    for f in sorted(found, key=lambda f: (f.start, -f.confidence)):
        if not kept or f.start >= kept[-1].end:
            kept.append(f)
        elif f.confidence > kept[-1].confidence:
            kept[-1] = f
    return sorted((f for f in kept if f.confidence >= least), key=lambda f: f.start)


def format_formulas(text: str | None) -> str | None:
    """The text with its formulas as LaTeX, in $$..$$ if longer than 50 characters, else in $..$."""
    for f in reversed(find_formulas(text)):
        fence = "$$" if f.block else "$"
        text = f"{text[: f.start]}{fence}{f.latex}{fence}{text[f.end :]}"
    return text


def formula_block(text: str) -> str:
    return f"$$\n{tex(text.strip())}\n$$"


_KIND = "array<struct<start: int, end: int, original: string, latex: string, block: boolean, confidence: double>>"


def with_formulas(df: DataFrame, source: str = "text", out: str = "formulas") -> DataFrame:
    """Adds out, the formulas of a column of texts; empty where there are none."""
    make = lambda t: [(*f[:-1], round(f.confidence, 6)) for f in find_formulas(t)]
    return df.withColumn(out, python_column(df, source, make, _KIND))


def with_formatted(df: DataFrame, source: str = "text", out: str = "formatted") -> DataFrame:
    """Adds out, the texts with their formulas as LaTeX. Null stays null."""
    return df.withColumn(out, F.coalesce(python_column(df, source, format_formulas, "string"), F.col(source)))


def is_fragment(d: Dialect, t: str) -> str:
    """Whether stripped text t shows two signs or more of being part of a formula."""
    letters, digits = d.count(t, r"\p{L}"), d.count(t, "[0-9]")
    share = f"{digits} * 1.0 / nullif({letters} + {digits}, 0)"
    edge = f"({d.member(d.first(t), ['+', '-', '=', '('])} OR {d.member(d.last(t), ['+', '-', '=', ')'])})"
    signs = [
        f"{d.chars(t, '+-=×÷/^_')} > 0", f"{d.chars(t, SPECIAL)} > 0", f"coalesce({letters} > 0 AND {digits} > 0 AND {share} > 0.2 AND {share} < 0.8, FALSE)", edge,
        f"NOT {d.member(d.last(t), ['.', ',', ';', ':', '!', '?'])}",
    ]
    return f"(length({t}) BETWEEN 3 AND 200 AND {d.total([(s, '1') for s in signs])} >= 2)"


def is_complete(d: Dialect, t: str) -> str:
    """Whether stripped text t scores 3 or more as a whole formula."""
    terms = [
        (f"contains({t}, '=')", "3"), (f"{d.chars(t, '(')} = {d.chars(t, ')')}", "1"), (d.has(t, rf"[a-zA-Z]{S}*[=+\-*/]{S}*[a-zA-Z0-9]"), "2"), (f"length({t}) < 200", "1"),
    ]
    return f"({d.total(terms)} >= 3)"


def rejoined(d: Dialect, source: str) -> str:
    """doc_id, block_idx, combined: fragments that make a whole formula with the line after them."""
    after = f"SELECT doc_id, block_idx, text, lead(text) OVER (PARTITION BY doc_id ORDER BY block_idx) AS nxt FROM ({source}) AS s"
    both = f"SELECT doc_id, block_idx, text, concat(text, ' ', nxt) AS combined FROM ({after}) AS a WHERE nxt IS NOT NULL"
    return f"SELECT doc_id, block_idx, combined FROM ({d.once(both, part=is_fragment(d, 'text'), whole=is_complete(d, 'combined'))}) AS b WHERE part AND whole"
