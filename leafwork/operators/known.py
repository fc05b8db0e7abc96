"""Formulas known by what surrounds them: names, kinds and variables in the text beside, known results, LaTeX of words.

All of it is SQL over the text and its neighbours, for either dialect.
"""

from __future__ import annotations

from leafwork.functions.dialect import Dialect, S, S_IN, W
from leafwork.operators.formulas import confidence_class, confidence_percent, features
from leafwork.operators.notation import NAMES, PLAIN_LOWER

# The formulas' names by pattern, with what they say; the first that fits counts.
FORMULAS = [
    (rf"massa{S}+específica", "massa específica", "ρ = m/V"), (rf"peso{S}+específico", "peso específico", "γ = ρg"), ("densidade", "densidade", "ρ = m/V"), ("pressão", "pressão", "P = F/A"),
    ("viscosidade", "viscosidade", "μ"), (rf"tensão{S}+(superficial|cisalhante)", "tensão", "τ"), (rf"volume{S}+específico", "volume específico", "Vs = 1/ρ"), ("compressibilidade", "compressibilidade", "β"),
    (rf"módulo{S}+de{S}+elasticidade", "módulo de elasticidade", "E"), (rf"(lei|equação){S}+de{S}+stevin", "Lei de Stevin", "P = P₀ + ρgh"), (rf"(lei|equação){S}+de{S}+pascal", "Lei de Pascal", "P = F/A"),
    (rf"(lei|equação){S}+de{S}+newton", "Lei de Newton", "F = ma"), (rf"gases{S}+(perfeitos|ideais)", "Equação dos Gases", "PV = nRT"), (rf"de{S}+bernoulli", "Equação de Bernoulli", "P + ρv²/2 + ρgh = const"),
    (rf"da{S}+continuidade", "Equação da Continuidade", "A₁v₁ = A₂v₂"), (rf"stevin'?s?{S}+(law|equation)", "Lei de Stevin", "P = P₀ + ρgh"), (rf"pascal'?s?{S}+(law|principle)", "Lei de Pascal", "P = F/A"),
    (rf"ideal{S}+gas{S}+(law|equation)", "Equação dos Gases", "PV = nRT"),
]
# Variables with their names and meanings.
VARIABLES = [
    ("ρ", "rho", "massa específica, densidade"), ("γ", "gamma", "peso específico"), ("μ", "mu", "viscosidade dinâmica"), ("ν", "nu", "viscosidade cinemática"), ("τ", "tau", "tensão cisalhante"),
    ("σ", "sigma", "tensão normal"), ("ε", "epsilon", "deformação"), ("θ", "theta", "ângulo"), ("π", "pi", "constante pi"), ("Δ", "delta", "variação"), ("P", "p", "pressão"), ("V", "v", "volume"),
    ("T", "t", "temperatura"), ("F", "f", "força"), ("A", "a", "área"), ("m", "m", "massa"), ("g", "g", "aceleração da gravidade"), ("h", "h", "altura"), ("v", "v", "velocidade"), ("R", "r", "constante dos gases"),
    ("n", "n", "número de moles"), ("E", "e", "módulo de elasticidade"),
]
# Words that stand for a formula, in order.
KNOWN = [
    ("massa volume sendo", r"\rho = \frac{m}{V}"), ("volume massa sendo", r"\rho = \frac{m}{V}"), ("peso volume sendo", r"\gamma = \frac{W}{V}"), ("volume peso sendo", r"\gamma = \frac{W}{V}"),
    ("força área sendo", r"P = \frac{F}{A}"), ("área força sendo", r"P = \frac{F}{A}"), ("pressão altura", r"P = \rho g h"), ("viscosidade dinâmica", r"\mu"), ("viscosidade cinemática", r"\nu = \frac{\mu}{\rho}"),
    ("módulo compressibilidade", r"\beta = -\frac{1}{V}\frac{dV}{dP}"), ("gases perfeitos", r"PV = nRT"), ("nrt pv", r"PV = nRT"),
]
# Symbols, and words for functions.
SYMBOLS = {
    "∞": r"\infty", "∑": r"\sum", "∏": r"\prod", "∫": r"\int", "∂": r"\partial", "∇": r"\nabla", "√": r"\sqrt", "±": r"\pm", "∓": r"\mp", "×": r"\times", "÷": r"\div", "≤": r"\leq", "≥": r"\geq", "≠": r"\neq",
    "≈": r"\approx", "≡": r"\equiv", "∈": r"\in", "∉": r"\notin", "⊂": r"\subset", "⊃": r"\supset", "∪": r"\cup", "∩": r"\cap", "→": r"\rightarrow", "←": r"\leftarrow", "↔": r"\leftrightarrow",
    "⇒": r"\Rightarrow", "⇐": r"\Leftarrow",
}
CAPITALS = dict(zip("ΓΔΘΛΞΠΣΦΨΩ", "gamma delta theta lambda xi pi sigma phi psi omega".split()))
FUNCTIONS = {"sen": "sin", "cos": "cos", "tan": "tan", "tg": "tan", "log": "log", "ln": "ln", "exp": "exp", "lim": "lim", "max": "max", "min": "min"}
LABEL = rf"\(?{S}*[0-9]+{S}*[.,]{S}*[0-9]+{S}*\)?"


def formula_name(d: Dialect, beside: str, k: int = 1) -> str:
    """The name (k=1) or the formula (k=2) of what the lower-cased text beside speaks of; null if nothing is known."""
    return "CASE " + " ".join(f"WHEN {d.has(beside, f[0], fold=True)} THEN {d.lit(f[k])}" for f in FORMULAS) + " END"


def formula_kind(d: Dialect, beside: str) -> str:
    from leafwork.functions.text import word

    kinds = [("defini[çc][ãa]o|definid[ao]", "definição"), ("lei|law", "lei"), ("equa[çc][ãa]o|equation", "equação"), ("f[óo]rmula", "fórmula")]
    return "CASE " + " ".join(f"WHEN {d.has(beside, word(p))} THEN {d.lit(n)}" for p, n in kinds) + " END"


def variables(d: Dialect, beside: str) -> str:
    """The variables whose symbol, name or meaning the lower-cased text beside holds, joined by spaces, in their order.

    One-letter names are found inside words too; that is what the rule says.
    """
    each = [f"CASE WHEN {' OR '.join(f'contains({beside}, {d.lit(x)})' for x in dict.fromkeys(v))} THEN {d.lit(v[0])} ELSE '' END" for v in VARIABLES]
    return d.join(d.keep(d.array(*each), "v", "v <> ''"), " ")


def beside(d: Dialect) -> str:
    """The text before and after (columns before, after; null: none), lower-cased."""
    return "lower(concat(coalesce(before, ''), ' ', coalesce(after, '')))"


def neighbours(d: Dialect, source: str) -> str:
    """Blocks with the lines before and after them in the document."""
    w = "OVER (PARTITION BY doc_id ORDER BY block_idx)"
    return f"SELECT doc_id, block_idx, text, lag(text) {w} AS before, lead(text) {w} AS after FROM ({source}) AS s"


def contexts(d: Dialect, source: str) -> str:
    """doc_id, block_idx, name, hint, kind, variables that each line's neighbours tell."""
    near = f"SELECT doc_id, block_idx, {beside(d)} AS near FROM ({neighbours(d, source)}) AS n"
    return f"SELECT doc_id, block_idx, {formula_name(d, 'near')} AS name, {formula_name(d, 'near', 2)} AS hint, {formula_kind(d, 'near')} AS kind, {variables(d, 'near')} AS variables FROM ({near}) AS c"


def known_by_text(d: Dialect, low: str) -> str:
    """The formula that lower-cased, single-spaced text stands for; null if none."""
    has = lambda *words: "(" + " OR ".join(f"contains({low}, {d.lit(w)})" for w in words) + ")"
    cases = [(has(words), tex) for words, tex in KNOWN]
    cases += [
        (f"{has('massa')} AND {has('volume')} AND {has('peso')}", r"\gamma = \frac{W}{V}"), (f"{has('massa')} AND {has('volume')}", r"\rho = \frac{m}{V}"),
        (f"{has('pressão', 'pressao')} AND {has('força', 'forca', 'área', 'area')}", r"P = \frac{F}{A}"), (f"{has('stevin')} OR ({has('pressão')} AND {has('altura')} AND {has('peso')})", r"P = P_0 + \rho g h"),
        (f"{has('pv')} AND {has('nrt', 'mrt', 'gas')}", r"PV = nRT"),
    ]
    return "CASE " + " ".join(f"WHEN {c} THEN {d.lit(t)}" for c, t in cases) + " END"


def known_by_context(d: Dialect, low: str, name: str, hint: str) -> str:
    """The formula that the text or the name beside it stands for, else what the name says; null without a name."""
    cases = " ".join(f"WHEN contains({low}, {d.lit(w)}) OR contains(lower({name}), {d.lit(w)}) THEN {d.lit(t)}" for w, t in KNOWN)
    return f"CASE WHEN {name} IS NULL THEN NULL {cases} ELSE {hint} END"


_OPEN, _SHUT = "\ufdd0", "\ufdd1"  # fences: code points that no text holds


def _words_replaced(d: Dialect, x: str, words: dict[str, str]) -> str:
    """Whole words, in any case, by others: words are fenced first, so that neighbours don't share a border."""
    x = d.sub(x, f"({W}+)", rf"{_OPEN}\1{_SHUT}")
    for word, to in words.items():
        x = d.sub(x, f"{_OPEN}{word}{_SHUT}", to, fold=True)
    return f"translate({x}, {d.lit(_OPEN + _SHUT)}, '')"


def words_to_latex(d: Dialect, x: str) -> str:
    """Text as LaTeX: without an equation's number; names of letters, symbols, scripts, functions, fractions, powers.

    Letters that have a capital of their own become it, as the second, case-blind look at names does.
    """
    capital = set(CAPITALS.values())
    x = d.sub(x, LABEL)
    x = _words_replaced(d, x, {n: "\\" + (n.capitalize() if n in capital else n) for n in NAMES if n != "o"})
    for c, t in (SYMBOLS | PLAIN_LOWER | {c: "\\" + n.capitalize() for c, n in CAPITALS.items()}).items():
        x = f"replace({x}, {d.lit(c)}, {d.lit(t)})"
    for digits, mark in (("₀₁₂₃₄₅₆₇₈₉", "_"), ("⁰¹²³⁴⁵⁶⁷⁸⁹", "^")):
        for k, c in enumerate(digits):
            x = f"replace({x}, {d.lit(c)}, {d.lit(f'{mark}{k}')})"
    x = _words_replaced(d, x, {w: "\\" + f for w, f in FUNCTIONS.items()})
    x = d.sub(x, rf"({W}+){S}*/{S}*({W}+)", r"\frac{\1}{\2}")
    x = d.sub(d.sub(x, r"\^([0-9]+)", r"^{\1}"), r"_([0-9]+)", r"_{\1}")
    return d.strip(d.sub(d.sub(x, r"\\\\+", "\\"), f"{S}+", " "))


def label(d: Dialect, t: str) -> str:
    """An equation's number in the text, without brackets; null if there is none."""
    found = d.group(t, f"({LABEL})")
    return f"nullif({d.sub(found, f'^[() ]+|[() ]+\\z')}, '')"


def _scored(d: Dialect, source: str) -> str:
    f = features(d, "text")
    inner = d.once(neighbours(d, source), **f)
    return d.once(f"SELECT *, {confidence_percent(d)} AS points FROM ({inner}) AS f", confidence=confidence_class("points"))


def rebuilt(d: Dialect, source: str) -> str:
    """doc_id, block_idx, text, confidence, label, name, hint, latex: each line as a formula, with its neighbours' help.

    A line that is no formula stays as it is. Else a known formula by context or by text, else its words as LaTeX.
    """
    near = f"SELECT *, {beside(d)} AS near, {d.strip(d.sub('lower(text)', f'{S}+', ' '))} AS low FROM ({_scored(d, source)}) AS s"
    near = f"SELECT * FROM ({d.once(near, number=label(d, 'text'))}) AS o"
    some = lambda x: f"CASE WHEN confidence <> 'none' THEN {x} END"
    named = d.once(near, found=some(formula_name(d, "near")), says=some(formula_name(d, "near", 2)))
    tex = f"CASE WHEN confidence = 'none' THEN text ELSE coalesce({known_by_context(d, 'lower(text)', 'found', 'says')}, {known_by_text(d, 'low')}, {words_to_latex(d, 'text')}) END"
    return f"SELECT doc_id, block_idx, text, confidence, number AS label, CASE WHEN confidence <> 'none' THEN found END AS name, CASE WHEN confidence <> 'none' THEN says END AS hint, {tex} AS latex FROM ({named}) AS n"


def formatted(d: Dialect, source: str) -> str:
    """doc_id, block_idx, shown: lines that are formulas in $..$ or, if surer, in $$..$$ with their name or number.

    High confidence counts below 80 characters, medium below 60; all other lines stay.
    """
    tail = "CASE WHEN name IS NOT NULL THEN concat(' *(', name, ')*') WHEN label IS NOT NULL THEN concat(' *(', label, ')*') ELSE '' END"
    shown = f"CASE WHEN confidence = 'high' AND length(text) < 80 THEN concat('$$', latex, '$$', {tail}) WHEN confidence = 'medium' AND length(text) < 60 THEN concat('$', latex, '$') ELSE text END"
    return f"SELECT doc_id, block_idx, {shown} AS shown FROM ({rebuilt(d, source)}) AS r"


def described(d: Dialect, source: str) -> str:
    """doc_id, block_idx, description: a named formula's name and what it says, else the text."""
    return f"SELECT doc_id, block_idx, CASE WHEN name IS NULL THEN text ELSE concat('*', name, '*: $', hint, '$') END AS description FROM (SELECT c.*, text FROM ({contexts(d, source)}) AS c JOIN (SELECT doc_id AS d0, block_idx AS b0, text FROM ({source}) AS s) AS t ON doc_id = d0 AND block_idx = b0) AS j"


def readable(d: Dialect, t: str) -> str:
    """The words of t that read as prose: four letters or more, little words that connect, numbers of two digits."""
    edge = r"[.,;:()\[\]{}]"
    own = d.sub("w", rf"^{edge}+|{edge}+\z")
    keep = (
        f"({d.has(own, r'^\p{L}{4,}\z')} AND NOT {d.member(f'lower({own})', ['sendo', 'onde', 'temos'])}) OR (NOT {d.has(own, r'^\p{L}{4,}\z')} AND ({d.member(f'lower({own})', ['é', 'são', 'ou', 'e', 'como', 'para', 'que'])}"
        f" OR {d.has(own, r'^[0-9]{2,}[.,]?[0-9]*\z')}))"
    )
    return d.join(d.keep(d.split(t, f"[{S_IN}]+"), "w", keep), " ")
