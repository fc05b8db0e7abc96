"""Cleaning and classifying extracted text: expressions over a text column, for either dialect."""

from __future__ import annotations

from leafwork.functions.dialect import Dialect, NW, S, W

# What the symbol-font codes U+F020.. stand for, in order of their codes.
PUA_FROM = "".join(chr(c) for c in (
    *range(0xF020, 0xF030), *range(0xF03A, 0xF07B), 0xF0A3, 0xF0A5, 0xF0A7, 0xF0A8, *range(0xF0AB, 0xF0B0), *range(0xF0B3, 0xF0C0),
    0xF0C5, *range(0xF0C7, 0xF0D2), 0xF0D6, 0xF0D7, 0xF0DB, 0xF0DE, 0xF0E4, 0xF0E5, 0xF0F2, 0xF0FB, 0xF0FC, 0xF0FE,
))
PUA_TO = (
    " !∀#∃%&∋()∗+,−./"
    ":;<=>?≅ΑΒΧΔΕΦΓΗΙϑΚΛΜΝΟΠΘΡΣΤΥςΩΞΨΖ[∴]⊥_‾αβχδεφγηιϕκλμν●πθρστυ✔ωξψζ"
    "≤∞■□"
    "↔↑↓→←"
    "≥×∝∂•÷≠≡≈…|─↵"
    "∏∩∪⊃⊇⊄⊂⊆∈∉°⇐"
    "√∛⇔⇒⊗∑∫✗✓☐"
)
assert len(PUA_FROM) == len(PUA_TO)

# The classifier's symbols, operators and patterns.
MATH_SYMBOLS = "αβγδεζηθικλμνξοπρστυφχψωΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ∞∑∏∫∂∇√∛∜±×÷·≤≥≠≈≡∝∈∉⊂⊃⊆⊇∪∩∅∀∃∧∨¬→←↔⇒⇐⇔"
MATH_OPERATORS = "+-*/=<>^_"
GREEK_WORDS = "alpha|beta|gamma|delta|epsilon|zeta|eta|theta|iota|kappa|lambda|mu|nu|xi|omicron|pi|rho|sigma|tau|upsilon|phi|chi|psi|omega"
FUNCTIONS = "sen|cos|tan|log|ln|exp|sin|tg|ctg|sec|csc|arcsen|arccos|arctan|sinh|cosh|tanh|lim|max|min|sup|inf"
INSTITUTIONS = [rf"universidade{S}+(federal|estadual|de)", rf"faculdade{S}+de", rf"instituto{S}+(federal|de)", rf"prof[aª]?\.{S}", rf"©{S}*\d{{4}}", rf"all{S}+rights{S}+reserved", rf"todos{S}+os{S}+direitos"]
PREPOSITIONS = "de|do|da|dos|das|em|no|na|nos|nas|a|o|e|ou|para|com"
UP = "[A-ZÀ-Ú]"
FOLDED_UP = "[A-ZÀ-Úa-zà-ú]"  # the class under case folding


def word(body: str) -> str:
    """body as a whole word, for a search."""
    return rf"(^|{NW})({body})({NW}|\z)"


def symbols_to_text(d: Dialect, x: str) -> str:
    """Symbol-font codes as the characters they stand for, other private-use characters as spaces."""
    return d.sub(f"translate({x}, {d.lit(PUA_FROM)}, {d.lit(PUA_TO)})", r"[\x{E000}-\x{F8FF}]", " ")


def page_artifacts(d: Dialect, x: str) -> str:
    """Page numbers left in a line: in $..$, before a capital at the start, after two spaces at the end."""
    x = d.sub(x, rf"\$(\d{{1,3}}){S}*([A-ZÀ-Úa-zà-ú][a-zà-ú]*)\$", r"\2")
    x = d.sub(x, r"\$\d{1,3}\$")
    x = d.sub(x, rf"^(\d{{1,3}}){S}+({UP})", r"\2")
    return d.sub(x, rf"{S}{{2,}}\d{{1,3}}{S}*\z")


def whitespace(d: Dialect, x: str) -> str:
    """Three and more spaces as two, tabs as one space, no spaces at the ends of lines."""
    return d.sub(d.sub(d.sub(x, " {3,}", "  "), r"\t+", " "), r"(?m)^ +| +$")


def control_chars(d: Dialect, x: str) -> str:
    return d.sub(x, r"[\x{0000}-\x{0008}\x{000B}-\x{001F}\x{007F}]")


def clean_text(d: Dialect, x: str) -> str:
    return d.strip(control_chars(d, whitespace(d, page_artifacts(d, symbols_to_text(d, x)))))


def is_page_furniture(d: Dialect, t: str) -> str:
    """Whether stripped text t is a header or footer."""
    institution = "(" + " OR ".join(d.has(t, p, fold=True) for p in INSTITUTIONS) + ")"
    rules = [
        d.has(t, r"^\d{1,4}\z"),
        d.has(t, rf"^(página|page|pág\.?){S}*\d+", fold=True),
        d.has(t, r"^[A-Z]{2,}\d{2,}"),
        f"({d.times(t, '  ')} >= 2 AND length({t}) > 50)",
        d.has(t, rf"{S}{{2,}}\d{{1,3}}{S}*\z"),
        f"({institution} AND (length({t}) < 150 OR {d.times(t, '  ')} >= 1))",
        f"(length({t}) > 120 AND NOT contains({t}, {d.newline()}) AND {d.has(t, rf'(–|—|-){S}*\d+{S}*\z')})",
    ]
    return f"(length({t}) >= 2 AND ({' OR '.join(rules)}))"


def repeat_key(d: Dialect, x: str) -> str:
    """What two running heads share: lower case, single spaces, no page number at the end."""
    return d.sub(d.sub(f"lower({d.strip(x)})", rf"{S}+\d{{1,3}}{S}*\z"), f"{S}+", " ")


def is_garbage(d: Dialect, x: str) -> str:
    t = d.strip(x)
    letters = d.count(d.sub(f"concat(' ', {t}, ' ')", NW, "  "), r" [A-Za-zÀ-ú]{3,} ")
    return "(" + " OR ".join([
        f"length({x}) < 3",
        d.has(t, rf"^[\d{S[1:-1]}.,\-–—:;/\\()]+\z"),
        d.has(t, rf"^[{S[1:-1]}$αβγδεζηθικλμνξπρστυφχψωρΓΔ∞∑∏∫∂∇√±×÷≤≥≠≈∈∉⊂⊃∪∩+\-*/^_=<>]+\z"),
        f"(length({t}) > 20 AND {letters} < 2)",
        d.has(t, rf"(Sistema|MKS|CGS|S\.I\.){S}*[:.]?{S}*{W}{{1,3}}{S}+{W}{{1,3}}"),
    ]) + ")"


def clean_artifacts(d: Dialect, cleaned: str) -> str:
    """Residue of page furniture in cleaned text; empty where nothing is left."""
    t = d.sub(cleaned, rf"^[A-Z]{{2,}}\d{{2,}}{S}*[-–—]{S}*[^.]+{S}*\z")
    heads = "(" + " OR ".join([
        d.has(t, rf"^[^\n]*Universidade{S}+Federal[^\n]*\n?\z", fold=True), d.has(t, rf"^[^\n]*Faculdade{S}+de{S}+Engenharia[^\n]*\n?\z", fold=True), d.has(t, rf"^Prof[aª]?\.{S}+{W}+[^\n]*\n?\z", fold=True),
    ]) + ")"
    t = d.strip(f"CASE WHEN {heads} AND length({t}) < 100 THEN '' ELSE {t} END")
    return f"CASE WHEN {d.has(t, rf'^[\d{S[1:-1]}.,\-–—]+\z')} OR (length({t}) < 3 AND length({cleaned}) > 10) THEN '' ELSE {t} END"


def _not_heading(d: Dialect, t: str) -> list[str]:
    """Conditions on stripped text under which neither a candidate nor a level is given."""
    return [
        f"({d.has(t, r'^[A-Za-z]{1,5}\z')} AND NOT {d.is_upper(t)})",
        d.has(t, rf"^(A|O|As|Os|Um|Uma){S}+{W}+\z"),
        d.has(t, rf"^(Figura|Figure|Fig\.?|Tabela|Table|Tab\.?){S}*\d", fold=True),
        f"({d.has(t, rf'^\d+\.\d+{S}*[-–—]')} AND CAST(right(concat('0', {d.group(t, rf'^\d+\.(\d+){S}*[-–—]')}), 9) AS BIGINT) > 12)",
        f"({d.has(t, rf'{S}+({PREPOSITIONS}){S}*\z', fold=True)} AND NOT {d.is_upper(t)})",
    ]


def is_heading_candidate(d: Dialect, t: str, size: str) -> str:
    """t: stripped text. Weight plays no part."""
    no = " OR ".join([
        f"length({t}) > 150", f"length({t}) < 3", *_not_heading(d, t), f"({d.has(t, rf'^[1-9]{S}*[-–—]{S}*{UP}')} AND NOT contains(substr({t}, 1, 5), '.'))",
    ])
    yes = " OR ".join([
        d.has(t, rf"^(CAPÍTULO|CAPITULO|PARTE|CHAPTER|UNIT|SEÇÃO|SECAO|SECTION){S}+\d+", fold=True),
        d.has(t, rf"^\d+\.\d+{S}*[-–—]?{S}*{FOLDED_UP}"),
        d.has(t, r"^\d+\.\d+\.\d+"),
        f"({size} > 16 AND {d.is_upper(t)} AND length({t}) > 5)",
    ])
    return f"(NOT ({no}) AND ({yes}))"


def heading_level(d: Dialect, t: str, size: str) -> str:
    """0 to 4 for stripped text t."""
    up = f"upper({t})"
    cases = [
        (f"length({t}) < 3 OR " + " OR ".join(_not_heading(d, t)), 0),
        (d.has(up, rf"^(CAPÍTULO|CAPITULO|PARTE|CHAPTER|UNIT){S}+\d+"), 1),
        (f"{d.is_upper(t)} AND length({t}) > 5 AND {size} > 16", 1),
        (f"{d.has(t, rf'^\d+\.\d+{S}*[-–—]?{S}*{UP}')} AND NOT {d.has(t, r'^\d+\.\d+\.\d+')}", 2),
        (f"{d.has(t, rf'^\d+\.\d+\.\d+{S}*[-–—]?{S}*{UP}')} AND NOT {d.has(t, r'^\d+\.\d+\.\d+\.\d+')}", 3),
        (d.has(t, r"^\d+\.\d+\.\d+\.\d+"), 4),
        (f"{size} > 18 AND {d.is_upper(t)}", 1),
        (f"{size} > 16 AND length({t}) < 80", 2),
    ]
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in cases) + " ELSE 0 END"


def isolated_letters(d: Dialect, x: str) -> str:
    """Letters A-Z that are words of their own."""
    return d.count(d.sub(f"concat(' ', {x}, ' ')", NW, "  "), " [A-Za-z] ")


def formula_hundredths(d: Dialect, t: str) -> str:
    """The formula score of stripped text in hundredths, at most 100."""
    sym, op, lone = d.chars(t, MATH_SYMBOLS), d.chars(t, MATH_OPERATORS), isolated_letters(d, t)
    terms = [
        f"least(30, {sym} * 10)", f"least(20, {op} * 5)",
        d.total([
            (d.has(t, rf"(^|{NW})\d+{S}*[/÷]{S}*\d+({NW}|\z)"), "30"), (d.has(t, rf"{W}{S}*[\^²³⁴⁵⁶⁷⁸⁹]"), "25"), (d.has(t, rf"{W}{S}*[_₀₁₂₃₄₅₆₇₈₉]"), "20"), (d.has(t, "[=≈≠<>≤≥]"), "20"),
            (d.has(t, word(GREEK_WORDS), fold=True), "25"), (d.has(t, word(FUNCTIONS), fold=True), "30"), (d.has(t, rf"\({S}*\d+\.\d+{S}*\)"), "40"),
            (d.has(t, rf"(^|{NW})([a-zA-Z]{S}+){{2,}}([=:]|sendo)"), "35"),
        ]),
        f"CASE WHEN {lone} > 2 THEN least(20, {lone} * 3) ELSE 0 END",
    ]
    return f"CASE WHEN length({t}) < 2 THEN 0 ELSE least(100, {' + '.join(terms)}) END"


def is_margin_text(d: Dialect, t: str) -> str:
    """Header or footer by the classifier's own, shorter list of rules."""
    institution = " OR ".join(d.has(t, p, fold=True) for p in (rf"universidade{S}+(federal|estadual)", rf"faculdade{S}+de", rf"instituto{S}+(federal|de)", rf"©{S}*\d{{4}}"))
    return (
        f"({d.has(t, r'^[A-Z]{2,}\d{2,}')} OR {d.has(t, rf'(página|page|pág\.?){S}*\d+', fold=True)} OR (length({t}) > 80 AND {d.times(t, '  ')} >= 2)"
        f" OR (({institution}) AND length({t}) < 150))"
    )


def text_type(d: Dialect, t: str, score: str) -> str:
    """Type of stripped text t with its formula score in hundredths."""
    return (
        f"CASE WHEN {t} = '' THEN 'normal' WHEN {d.has(t, r'^\d{1,4}\z')} THEN 'page_number' WHEN {is_margin_text(d, t)} THEN 'header_footer' WHEN {score} > 70 THEN 'formula'"
        f" WHEN {score} > 40 THEN 'formula_fragment' WHEN {d.has(t, rf'^[\d\-•◦▪→]{S}')} THEN 'list_item' ELSE 'normal' END"
    )


def equation_label(d: Dialect, x: str) -> tuple[str, str]:
    """(text without its trailing (n.m), the label or null)."""
    p = rf"{S}*\((\d+\.\d+)\){S}*\z"
    return f"CASE WHEN {d.has(x, p)} THEN {d.strip(d.sub(x, p))} ELSE {x} END", f"nullif({d.group(x, p)}, '')"


def safe_filename(d: Dialect, x: str) -> str:
    return d.sub(x, r'[<>:"/\\|?*]', "_")


def markdown_spacing(d: Dialect, x: str) -> str:
    """At most one blank line in a row, no spaces before line ends, nothing around."""
    return d.strip(d.sub(d.sub(x, r"\n\n\n+", "\n\n"), r"[ \t]+\n", "\n"))
