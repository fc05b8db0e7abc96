"""Mathematical spans within lines: where they are, how lines split at them, and LaTeX in their place.

Each rule is a pattern and a judgement of its matches; the matches of all rules are united, overlaps resolved, close
neighbours joined and edges trimmed. Positions count characters. Lines without any character that a rule needs are
kept from Python by a native test.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from leafwork.functions.dialect import Dialect, NW, S, SPARK, W
from leafwork.operators.notation import GREEK, LOWER, SPAN_OPERATORS, SUBSCRIPTS, SUPERSCRIPTS, UPPER, VARIANTS, longest_first, python_column

# The characters of mathematics, names of functions, everyday words, and signs of addresses.
LETTERS = LOWER + UPPER + "".join(VARIANTS)
SIGNS = "+-×÷·±∓=≠≈≡≤≥<>∞∝"
RELATIONS = "=≠≈≡≤≥<>∼≃≅∝∈∉⊂⊃⊆⊇"
BIG = "∑∏∫∬∭∮∂∇√∛∜"
SUPERS, SUBS = "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿⁱ", "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎ₐₑₒₓₙₕₖₗₘₚₛₜ"
NAMES = (
    "sin cos tan cot sec csc arcsin arccos arctan arccot sinh cosh tanh coth sen tg cotg cossec log ln lg exp lim max min sup inf det dim ker Im Re gcd lcm mod arg sqrt root"
).split()
SURE_NAMES = {"sin", "cos", "tan", "sen", "log", "ln", "exp"}
EVERYDAY = set((
    "de da do das dos em no na nos nas um uma uns umas o a os as que se para por com sem e ou mas porém contudo é são foi foram ser estar"
    " the a an of in on at to for with and or but is are was were"
).split())
COMPOUNDS = {"e-mail", "on-line", "off-line", "check-in", "check-out", "know-how", "up-to-date"}
ADDRESS = ("http", "https", "ftp", "file://", "www.", ".png", ".jpg", ".pdf", ".md", ".txt", ".html", "images/", "img/")

# The patterns.
_G, _O = re.escape(LETTERS), re.escape(SIGNS)
_DIGITS = "₀₁₂₃₄₅₆₇₈₉⁰¹²³⁴⁵⁶⁷⁸⁹"
_SIDE = rf"(\(?[a-zA-Z0-9{_G}]+(?:[\+\-\*][a-zA-Z0-9]+)*\)?)"
EQUATION = re.compile(rf"([a-zA-Z{_G}]\w*(?:[{_DIGITS}]+)?)\s*=\s*([^\s,;:.!?\)]+(?:\s*[\+\-\*/]\s*[^\s,;:.!?\)]+)*)")
FRACTION = re.compile(rf"(?<![/\w]){_SIDE}\s*/\s*{_SIDE}(?![/\w])")
FUNCTION = re.compile(rf"\b({longest_first(NAMES)})(?:_?\{{?[a-zA-Z0-9]+\}}?)?\s*[\(\[]([^)\]]+)[\)\]]", re.IGNORECASE)
GREEK_EQUATION = re.compile(rf"([{_G}][{_DIGITS}]*)\s*=\s*([^\s,;:.!?]+(?:\s*[\+\-\*/]\s*[^\s,;:.!?]+)*)")
VARIABLE = re.compile(rf"([a-zA-Z{_G}])([₀₁₂₃₄₅₆₇₈₉ₐₑₒₓₙₕₖₗₘₚₛₜ]+|[⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻ⁿⁱ]+|_\{{?[a-zA-Z0-9,]+\}}?|\^\{{?[a-zA-Z0-9,]+\}}?)")
ROOT = re.compile(rf"[√∛∜][\(\{{]?([a-zA-Z0-9{_G}\+\-\*/ ]+)[\)\}}]?")
SUM = re.compile(r"[∑∏](?:_\{?([^}]+)\}?)?(?:\^\{?([^}]+)\}?)?\s*([^\s]+)?")
INTEGRAL = re.compile(r"[∫∬∭∮](?:_\{?([^}]+)\}?)?(?:\^\{?([^}]+)\}?)?\s*([^d]*)d([a-zA-Z])")
BRACKETED = re.compile(rf"\(([^)]*[{_O}+=\-\*/\^_][^)]*)\)")
POWER = re.compile(rf"([a-zA-Z0-9{_G}\)]+)[\^²³⁴⁵⁶⁷⁸⁹⁰¹⁺⁻ⁿⁱ]+")
EXPRESSION = re.compile(rf"(?<![a-zA-Z])([a-zA-Z{_G}][{_DIGITS}]*(?:\s*[{_O}+=\-\*/\^_<>]\s*[a-zA-Z0-9{_G}{_DIGITS}\(\)]+)+)(?![a-zA-Z])")


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    confidence: float

    @property
    def length(self) -> int:
        return self.end - self.start


def _any(text: str, names: str) -> bool:
    return any(c in names for c in text)


def _is_math_character(c: str) -> bool:
    return c in LETTERS or c in SIGNS or c in RELATIONS or c in BIG or c in SUPERS or c in SUBS or 0x1D400 <= ord(c) <= 0x1D7FF


def likely(text: str) -> bool:
    """Holds a character of mathematics; or is short, with / ^ _, and not of everyday words alone."""
    if any(map(_is_math_character, text)):
        return True
    return _any(text, "/^_") and len(text) < 20 and not all(w.lower() in EVERYDAY for w in text.split())


def _judge_equation(text: str, m: re.Match) -> float | None:
    name, value = m[1], m[2]
    if not likely(f"{name}={value}"):
        return None
    return min(1.0, 0.6 + 0.2 * _any(name, LETTERS) + 0.15 * _any(value, LETTERS + SIGNS) + 0.1 * ("/" in value) + 0.05 * (len(value) < 15))


def _judge_fraction(text: str, m: re.Match) -> float | None:
    around = text[max(0, m.start() - 20) : m.end() + 20].lower()
    if any(sign in around for sign in ADDRESS):
        return None
    a, b = m[1], m[2]
    short = lambda n: len(a) <= n and len(b) <= n
    return min(1.0, 0.5 + 0.3 * short(3) + 0.2 * _any(a + b, LETTERS) + 0.2 * (a.isdigit() and b.isdigit()) + 0.25 * (a.isalpha() and b.isalpha() and short(2)))


def _judge_function(text: str, m: re.Match) -> float:
    return min(1.0, (0.85 if m[1].lower() in SURE_NAMES else 0.7) + 0.1 * _any(m[2], LETTERS + SIGNS))


def _judge_variable(text: str, m: re.Match) -> float | None:
    beside = text[max(0, m.start() - 1) : m.start()], text[m.end() : m.end() + 1]
    return None if any(c.isalpha() for c in beside) else 0.75


def _judge_expression(text: str, m: re.Match) -> float | None:
    own = m[1]
    if len(own) < 3 or not likely(own) or own.lower() in COMPOUNDS:
        return None
    around = text[max(0, m.start() - 10) : m.start() + len(own) + 10]
    if "http" in around.lower() or "www." in around.lower() or any(sign in around for sign in ("://", ".com", ".org")):
        return None
    greek, signs = sum(c in LETTERS for c in own), sum(c in SIGNS + "/^_" for c in own)
    return min(1.0, 0.5 + min(0.1 * greek, 0.3) + min(0.1 * signs, 0.2) + 0.1 * (len(own) <= 30))


def _always(confidence: float):
    return lambda text, m: confidence


#: In the order in which equal starts and lengths are preferred.
RULES = [
    ("equation", EQUATION, _judge_equation), ("fraction", FRACTION, _judge_fraction), ("function", FUNCTION, _judge_function), ("greek_equation", GREEK_EQUATION, _always(0.85)),
    ("variable", VARIABLE, _judge_variable), ("root", ROOT, _always(0.9)), ("summation", SUM, _always(0.9)), ("integral", INTEGRAL, _always(0.9)),
    ("expression", BRACKETED, lambda text, m: 0.7 if likely(m[1]) else None), ("expression", POWER, _always(0.8)), ("expression", EXPRESSION, _judge_expression),
]


def without_overlaps(spans: list[Span]) -> list[Span]:
    """By start, longer first; a span that meets a kept one replaces it only if it is both surer and longer."""
    kept: list[Span] = []
    for s in sorted(spans, key=lambda s: (s.start, -s.length)):
        rival = next((k for k in kept if s.start < k.end and k.start < s.end), None)
        if rival is None:
            kept.append(s)
        elif s.confidence > rival.confidence and s.length > rival.length:
            kept.remove(rival)
            kept.append(s)
    return kept


def joined(spans: list[Span], text: str, gap: int = 3) -> list[Span]:
    """Neighbours with nothing, or one sign or comma, within `gap` characters between them are one expression."""
    out: list[Span] = []
    for s in sorted(spans, key=lambda s: s.start):
        last = out[-1] if out else None
        between = text[last.end : s.start].strip() if last else ""
        if last and s.start - last.end <= gap and (not between or (len(between) == 1 and between in SIGNS + ",")):
            out[-1] = Span(last.start, s.end, "expression", max(last.confidence, s.confidence))
        else:
            out.append(s)
    return out


def trimmed(span: Span, text: str) -> Span:
    """Grown to the brackets that it stands in, if they close after it; without punctuation at its end."""
    start, end = span.start, span.end
    if start and text[start - 1] == "(":
        depth = 1
        for i in range(end, len(text)):
            depth += (text[i] == "(") - (text[i] == ")")
            if not depth:
                start, end = start - 1, i + 1
                break
    while end > start and text[end - 1] in ".,;:!?":
        end -= 1
    return span._replace(start=start, end=end)


def find_spans(text: str | None, least: float = 0.5, shortest: int = 2, longest: int = 200) -> list[Span]:
    """The mathematical spans of a line in order."""
    if not text or len(text.strip()) < shortest:
        return []
    found = []
    for kind, pattern, judge in RULES:
        for m in pattern.finditer(text):
            confidence = judge(text, m)
            if confidence is not None and confidence >= least and shortest <= m.end() - m.start() <= longest:
                found.append(Span(m.start(), m.end(), kind, confidence))
    return sorted((trimmed(s, text) for s in joined(without_overlaps(found), text)), key=lambda s: s.start)


def segments(text: str | None) -> list[tuple[str, bool]]:
    """The line as (text, is it mathematics) in order; a line without spans is one part."""
    out, upto = [], 0
    for s in find_spans(text):
        out += [(text[upto : s.start], False)] if s.start > upto else []
        out.append((text[s.start : s.end], True))
        upto = s.end
    return out + ([(text[upto:], False)] if text and upto < len(text) else []) if out else [(text or "", False)]


# Functions with a command, and Portuguese names.
_COMMANDS = "sin cos tan cot sec csc arcsin arccos arctan arccot sinh cosh tanh coth log ln lg exp lim max min sup inf det dim ker arg gcd mod".split()
_PORTUGUESE = {"sen": r"\sin", "tg": r"\tan", "cotg": r"\cot", "cossec": r"\csc", "arcsen": r"\arcsin", "arctg": r"\arctan"}
_BASE = f"a-zA-Z0-9{LOWER}ΓΔΘΛΞΠΣΦΨΩ"
_OVER = rf"(\(?[{_BASE}]+(?:[\+\-\*][a-zA-Z0-9]+)*\)?)"
_STEPS = {
    "over": re.compile(rf"{_OVER}\s*/\s*{_OVER}"), "sup": re.compile(rf"([{_BASE}\)])([{SUPERS}]+)"), "sub": re.compile(rf"([{_BASE}])([{SUBS}]+)"),
    "root": re.compile(r"([√∛∜])\s*(?:\(([^)]+)\)|([a-zA-Z0-9]+))"), "call": re.compile(rf"\b({longest_first([*_COMMANDS, *_PORTUGUESE])})\b(?:_([a-zA-Z0-9]+))?\s*\(([^)]+)\)", re.IGNORECASE),
}
_GREEK = [(tex, re.compile(f"{c}([a-zA-Z])?"), c) for c, tex in GREEK.items()]


def greek(text: str) -> str:
    """Greek letters by their commands, with a space where a Latin letter follows."""
    for tex, pattern, c in _GREEK:
        if c in text:
            text = pattern.sub(lambda m: f"{tex} {m[1]}" if m[1] else tex, text)
    return text


def fraction(above: str, below: str, style: str = "frac") -> str:
    return f"\\{style}{{{above}}}{{{below}}}"


def _script(mark: str, names: dict[str, str]):
    def show(m: re.Match) -> str:
        plain = "".join(names.get(c, c) for c in m[2])
        return f"{m[1]}{mark}{plain}" if len(plain) == 1 else f"{m[1]}{mark}{{{plain}}}"

    return show


def _call(m: re.Match) -> str:
    name = m[1].lower()
    base = f"_{{{m[2]}}}" if m[2] else ""
    return f"{_PORTUGUESE.get(name, chr(92) + name)}{base}({greek(m[3])})"


def span_to_latex(text: str, style: str = "frac") -> str:
    """A span's text as LaTeX without delimiters: Greek, fractions, scripts, signs, roots, functions, in this order.

    Signs come before roots, so a root sign is already a bare command when roots are read; that order is part of the result.
    """
    text = _STEPS["over"].sub(lambda m: fraction(greek(m[1].strip("()")), greek(m[2].strip("()")), style), greek(text))
    text = _STEPS["sup"].sub(_script("^", SUPERSCRIPTS), text)
    text = _STEPS["sub"].sub(_script("_", SUBSCRIPTS), text)
    text = re.sub(r"\s+", " ", "".join(f" {SPAN_OPERATORS[c]} " if c in SPAN_OPERATORS else c for c in text)).strip()
    head = {"√": r"\sqrt", "∛": r"\sqrt[3]", "∜": r"\sqrt[4]"}
    text = _STEPS["root"].sub(lambda m: f"{head[m[1]]}{{{greek(m[2] or m[3])}}}", text)
    return _STEPS["call"].sub(_call, text)


def line_to_latex(line: str | None, long: int = 40) -> str | None:
    """The line with its spans as LaTeX, in $$..$$ if longer than `long` or a sum or an integral, else in $..$."""
    if not line or not line.strip() or not holds_math(line):
        return line
    for s in reversed(find_spans(line)):
        tex = span_to_latex(line[s.start : s.end])
        fence = "$$" if len(tex) > long or s.kind in ("summation", "integral") else "$"
        line = f"{line[: s.start]}{fence}{tex}{fence}{line[s.end :]}"
    return line


_OBVIOUS = LETTERS + BIG + SUPERS + SUBS
_SIMPLE = re.compile(r"\b\w\s*=\s*\w|\b\w/\w\b")


def holds_math(text: str | None) -> bool:
    """A character of mathematics, a one-letter equation or a one-letter fraction."""
    return bool(text) and (_any(text, _OBVIOUS) or bool(_SIMPLE.search(text)))


def has_math(d: Dialect, t: str) -> str:
    """holds_math() as SQL."""
    return f"({d.chars(t, _OBVIOUS)} > 0 OR {d.has(t, rf'(^|{NW}){W}{S}*={S}*{W}')} OR {d.has(t, rf'(^|{NW}){W}/{W}({NW}|\z)')})"


def needs_conversion(d: Dialect, t: str) -> str:
    """Whether a line has a character that conversion changes."""
    return f"({d.chars(t, LETTERS + ''.join(SPAN_OPERATORS) + SUPERS + SUBS)} > 0)"


def _gate(t: str) -> str:
    """What no rule can do without, as SQL for Spark."""
    marks = "".join(dict.fromkeys(SIGNS + BIG + SUPERS + SUBS + "/*^_(["))
    return f"translate({t}, {SPARK.lit(marks)}, '') <> {t}"


_KIND = "array<struct<start: int, end: int, kind: string, confidence: double, span: string>>"


def with_spans(df: DataFrame, source: str = "text", out: str = "spans") -> DataFrame:
    """Adds out, the spans of a column of lines: start, end, kind, confidence, span; empty where there are none."""
    make = lambda t: [(s.start, s.end, s.kind, round(s.confidence, 6), t[s.start : s.end]) for s in find_spans(t)]
    return df.withColumn(out, python_column(df, source, make, _KIND, _gate(source)))


def with_segments(df: DataFrame, source: str = "text", out: str = "segments") -> DataFrame:
    """Adds out, the parts of a column of lines: text, is_math."""
    return df.withColumn(out, python_column(df, source, segments, "array<struct<text: string, is_math: boolean>>"))


def with_latex(df: DataFrame, source: str = "text", out: str = "latex") -> DataFrame:
    """Adds out, the lines with their spans as LaTeX; a text of several lines is converted line by line. Null stays null."""
    make = lambda t: t and "\n".join(line_to_latex(line) for line in t.split("\n"))
    made = python_column(df, source, make, "string", has_math(SPARK, source))
    return df.withColumn(out, F.coalesce(made, F.col(source)))
