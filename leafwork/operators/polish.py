"""Mathematical prose after extraction: joined and broken words, broken lines, spacing of symbols, LaTeX of equations.

A text goes through its phases in order; the passes over lines are sequential, so a text is one pass of Python.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from leafwork.operators.notation import ALPHABETS, PLAIN_LOWER, PLAIN_UPPER, python_column
from leafwork.operators.rebuild import consume

# Greek letters and symbols that stand apart, and the letters beside which they do.
GREEK = "αβγδεζηθικλμνξοπρστυφχψωΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"
SYMBOLS = "∞∑∫∂√≤≥≠≈∈∉⊂⊃∩∪→←↔⇒⇐⇔±×÷·∝∀∃∇∆"
LATIN = "a-zA-ZáéíóúàèìòùâêîôûãõçÁÉÍÓÚÀÈÌÒÙÂÊÎÔÛÃÕÇ"

# Words that extraction joins, each pair by a space.
JOINED = [
    r"\b([OAU])(conceito|fluido|líquido|gás|volume|peso|valor|módulo|sistema|princípio|equação)\b", r"\b([AO])(mecânica|pressão|força|energia|massa|densidade|viscosidade|temperatura|área|altura)\b",
    r"\b(É)(a|o|um|uma)\b", r"\b(fluidos?)(trata|comporta|escoa|deforma)\b", r"\b(definir|calcular|determinar|medir|analisar|obter|encontrar)(fluido|pressão|volume|massa|energia|força|valor)\b",
    r"\b(fluido|líquido|gás)(define|escoa|deforma|comporta)\b", r"\b(por)(menor|maior)\b", r"(\d+)(kgf|kg|N|Pa|atm|mmHg|m²|m³|cm²|cm³)\b",
]
# Words that extraction breaks after their first letter, and names and units that it spaces out.
BROKEN = (
    "Federal Universidade Juiz Fora Faculdade Engenharia Professor Profª Equilíbrio Estudos Transporte Cálculo Propriedade Ação Instalações Densidade Viscosidade Temperatura Pressão Mecânica"
    " Hidrostática Atmosférica Manométrica Absoluta"
).split()
SPACED = {
    r"\bU\s*F\s*J\s*F\b": "UFJF", r"\bU\s*F\s*M\s*G\b": "UFMG", r"\bU\s*S\s*P\b": "USP", r"\bU\s*N\s*I\s*C\s*A\s*M\s*P\b": "UNICAMP", r"\bkg\s*f\b": "kgf", r"\bm\s*/\s*s\s*²\b": "m/s²", r"\bN\s*/\s*m\s*²\b": "N/m²",
    r"\bPa\s*scal\b": "Pascal", r"\bHidro\s*stática\b": "Hidrostática", r"\bHidro\s*dinâmica\b": "Hidrodinâmica", r"\bTermo\s*dinâmica\b": "Termodinâmica",
}
UNITS = {r"\bkg\s*f\b": "kgf", r"\bm\s*m\s*Hg\b": "mmHg", r"\bK\s*Pa\b": "kPa", r"\bM\s*Pa\b": "MPa", r"\bN\s*\.\s*m\b": "N·m", r"\bN\s*\.\s*s\b": "N·s"}
REMAINS = [
    (r"m/V\s+m[−\-]massa/volume\s+ρ\s*=?\s*sendo\s+V[−\-]", "ρ = m/V (m = massa, V = volume)"), (r"G/V\s+G/V\s*[−\-]peso/volume\s+γ\s*=\s*sendo", "γ = G/V (G = peso, V = volume)"),
    (r"P/R\s*-pressão/temperatuabsoluta/do", "P/(RT) onde: P = pressão, R = constante do gás, T = temperatura absoluta"), (r"Sistema/Sistema\s+MK\*S:\s*γ\s*=\s*m/33", "Sistema MKS: γ em kgf/m³"),
    (r"H\s*2\s*O", "H₂O"), (r"H2O", "H₂O"), (r"\b([PTGV])(\d)\b", r"\1₍\2₎"),
]
BEFORE_SYMBOLS = "valor módulo coeficiente constante variável função equação fórmula expressão relação entre para com por sobre sob".split()
STRAY = re.compile(r"^\s*[/=+\-×÷]\s*$|^\s*\(\s*\)\s*$|^\s*sendo\s*$|^\s*onde:?\s*$", re.IGNORECASE)

_ITEM = re.compile(r"^([a-zA-Z]\)|[0-9]+[.)])\s*$")
_BROKEN = [(re.compile(rf"\b{w[0]}\s+{w[1:]}\b", re.IGNORECASE), w) for w in BROKEN]
_GENERIC = re.compile(r"\b([A-ZÁÉÍÓÚÀÈÌÒÙÂÊÎÔÛÃÕÇ])\s+([a-záéíóúàèìòùâêîôûãõç]{3,})\b")
_CALLED = re.compile(r"([𝑓fFgGhH])\s*\(\s*\)\s*=\s*\?")


def fixed_line(line: str) -> str:
    """One line with joined words parted, broken words joined, and doubled parts of equations and fractions left once."""
    if not line.strip():
        return line
    for pattern in JOINED:
        line = re.sub(pattern, r"\1 \2", line, flags=re.IGNORECASE)
    for pattern, word in _BROKEN:
        line = pattern.sub(word, line)
    line = _GENERIC.sub(r"\1\2", line)
    line = re.sub(
        r"(\w+)\s*=\s*(\w+)/(\w+)\s+(\w+)−(\w+)/(\w+)\s+\1\s*=\s*sendo\s+(\w+)−", lambda m: f"{m[1]} = {m[2]}/{m[3]} (sendo {m[2]} = {m[5]}, {m[3]} = ...)", line
    )
    line = re.sub(r"(\b[ρμγνε]\b)\s+\1", r"\1", re.sub(r"\s+=\s+sendo\s+", " sendo ", line))
    return re.sub(r"(\d+/\d+|\w/\w)\s+([a-zA-Z])\s*=\s*$", r"\2 = \1", re.sub(r"(\w+/\w+)\s+\1\b", r"\1", line))


def merged_lines(line: str, nxt: str) -> str | None:
    """What a line and the next make together, if the first is only a part; None where they stay apart."""
    line, nxt = line.strip(), nxt.strip()
    asked = re.match(r"^(\d+)\.\s*=\s*\?(.*)$", nxt)
    if asked and re.search(r"[𝑓fFgGhH]\s*\(\s*$", line):
        return f"{line}1/{asked[1]}) = ?{asked[2]}"
    called = _CALLED.search(nxt)
    part = re.match(r"^(?:([a-e]\))\s*)?(\d+/\d+)$", line)
    if called and part:
        whole = f"{called[1]}({part[2]}) = ?"
        return f"{part[1]} {whole}" if part[1] else _CALLED.sub(lambda m: whole, nxt)
    if re.search(r"=\s*\w+/\w+$", line) and nxt.lower().startswith("sendo"):
        return f"{line} ({nxt})"
    if re.search(r"[+\-×÷=]$", line) and re.match(r"^[\d\w(]", nxt):
        return f"{line} {nxt}"
    return None


def _merge(lines, i, out):
    made = merged_lines(lines[i], lines[i + 1]) if i + 1 < len(lines) else None
    return None if made is None else ([made], 2)


def _item(lines, i, out):
    if not _ITEM.match(lines[i].strip()):
        return None
    j = next((k for k in range(i + 1, len(lines)) if lines[k].strip()), None)
    return None if j is None or _ITEM.match(lines[j].strip()) else ([f"{lines[i].strip()} {lines[j].strip()}"], j + 1 - i)


def _whole_item(lines, i, out):
    marker = re.compile(r"^[a-zA-Z]\)$|^\d+[.)]$")
    if not marker.match(lines[i].strip()):
        return None
    j = next((k for k in range(i + 1, len(lines)) if lines[k].strip()), len(lines))
    end = next((k for k in range(j, len(lines)) if not lines[k].strip() or marker.match(lines[k].strip())), len(lines))
    return ([" ".join(x.strip() for x in [lines[i], *lines[j:end]])], end - i) if end > j else None


def joined_fragments(lines: list[str]) -> list[str]:
    return consume(lines, _merge)


def joined_items(text: str) -> str:
    """Markers of exercises on a line of their own take the lines after them, up to a blank one or the next marker."""
    return "\n".join(consume(text.split("\n"), _whole_item))


def spaced(text: str) -> str:
    """Greek letters and symbols apart from the words beside them."""
    text = re.sub(rf"([{GREEK}])([{LATIN}])", r"\1 \2", re.sub(rf"([{LATIN}])([{GREEK}])", r"\1 \2", text))
    text = re.sub(r"\bentre\s*([ρμγνεσπτφωαβδλθ])\s*e\s*([ρμγνεσπτφωαβδλθ])\b", r"entre \1 e \2", text)
    text = re.sub(r"Relação\s+entre\s*(\S+)\s*e\s*(\S+)", r"Relação entre \1 e \2", text)
    return re.sub(rf"\b({'|'.join(BEFORE_SYMBOLS)})([{GREEK}{SYMBOLS}])", r"\1 \2", text, flags=re.IGNORECASE)


_ITALIC = {c: p for c, p in ALPHABETS.items() if 0x1D434 <= ord(c) <= 0x1D467} | {"ℎ": "h"}
_TEX = {c: t for c, t in (PLAIN_LOWER | PLAIN_UPPER).items() if c != "Υ"}
_SUBS, _SUPERS = "₀₁₂₃₄₅₆₇₈₉", "⁰¹²³⁴⁵⁶⁷⁸⁹"


def equations_to_latex(text: str) -> str:
    """Italic letters as plain ones; Greek letters before =, scripts, roots, and functions and powers in $..$."""
    text = "".join(_ITALIC.get(c, c) for c in text)
    text = re.sub(rf"([{''.join(_TEX)}])\s*=", lambda m: f"${_TEX[m[1]]}$ =", text)
    for digits, mark in ((_SUBS, "_"), (_SUPERS, "^")):
        text = re.sub(rf"([a-zA-Z])([{digits}])", lambda m: f"${m[1]}{mark}{digits.index(m[2])}$", text)
    text = re.sub(r"(\w)([²³])", lambda m: f"${m[1]}^{_SUPERS.index(m[2])}$", text)
    text = re.sub(r"√\(([^)]+)\)", lambda m: f"$\\sqrt{{{m[1].strip()}}}$", text)
    text = re.sub(r"√([a-zA-Z0-9−\-])", lambda m: f"$\\sqrt{{{m[1]}}}$", text)
    return re.sub(r"(?<!\$)([a-zA-Z]\([a-zA-Z]\)\s*=\s*[a-zA-Z0-9\s+\-*/^\[\]()]+|[a-zA-Z]\s*\^\s*\d+)(?!\$)", lambda m: f"${m[0]}$", text)


def polished(text: str | None) -> str | None:
    """All phases: lines, lines that belong together, exercises, stray lines, spacing, LaTeX."""
    if not text:
        return text
    lines = consume(joined_fragments([fixed_line(line) for line in text.split("\n")]), _item)
    return equations_to_latex(spaced("\n".join(line for line in lines if not STRAY.match(line))))


def fraction_notation(text: str) -> str:
    """A number above a number, before a relation or the end, as a fraction."""
    return re.sub(r"(\d+)\s*\n\s*(\d+)(?=\s*[=<>]|\s*$)", r"\1/\2", text)


def technical_units(text: str) -> str:
    for pattern, to in UNITS.items():
        text = re.sub(pattern, to, text)
    return text


def formula_remains(text: str) -> str:
    for pattern, to in REMAINS:
        text = re.sub(pattern, to, text, flags=re.IGNORECASE)
    return text


def brazilian(text: str) -> str:
    """Names, units and terms of Brazilian technical texts, what is left of known formulas, and Greek pairs."""
    for pattern, to in SPACED.items():
        text = re.sub(pattern, to, text, flags=re.IGNORECASE)
    pair = "ρμγνεσπτφωαβδλθΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"
    return re.sub(rf"entre\s*([{pair}])\s*e\s*([{pair}])", r"entre \1 e \2", technical_units(formula_remains(text)))


def with_polished(df: DataFrame, source: str = "text", out: str = "polished") -> DataFrame:
    """Adds out, the texts after all phases. Null stays null."""
    return df.withColumn(out, F.coalesce(python_column(df, source, polished, "string"), F.col(source)))


def with_brazilian(df: DataFrame, source: str = "text", out: str = "fixed") -> DataFrame:
    """Adds out, the texts with technical names, units and known remains set right. Null stays null."""
    return df.withColumn(out, python_column(df, source, lambda t: t if t is None else brazilian(t), "string"))
