"""Heading predicates and scores over a stripped text column t, for either dialect."""

from __future__ import annotations

from leafwork.functions.dialect import Dialect, S, S_IN, W

# Stop words of the two languages, and the titles that say nothing.
STOPWORDS = sorted(set("""
de da do das dos a o as os e é em no na nos nas um uma uns umas que para por com não se ao aos ou seu sua seus suas são mais como mas foi ser tem já
está isso isto esse essa este esta pelo pela pelos pelas entre depois sobre mesmo quando muito também pode assim qual só bem sem ele ela eles elas me lhe lo la
the a an and or but in on at to for of with by from is are was were be been being have has had do does did will would could should may might must that
which who whom this these those it its as if than so such no not
""".split()))  # fmt: skip
GENERIC = (
    "sumário", "índice", "table of contents", "introdução", "introduction", "conclusão", "conclusion", "referências", "references", "apêndice", "appendix", "prefácio", "preface",
    "agradecimentos", "acknowledgments", "prólogo", "prologue", "nota", "notes", "observação", "observations",
)


def words(d: Dialect, t: str) -> str:
    """The words of t between white space."""
    return d.keep(d.split(t, f"{S}+"), "s", "s <> ''")


def word_count(d: Dialect, t: str) -> str:
    return d.count(t, f"[^{S_IN}]+")


def stopword_ratio(d: Dialect, t: str) -> str:
    """Share of stop words among the words."""
    stops = d.size(d.keep(words(d, f"lower({t})"), "w", d.member("w", STOPWORDS)))
    return f"CASE WHEN {word_count(d, t)} = 0 THEN {d.double('0')} ELSE {d.double(stops)} / {word_count(d, t)} END"


def has_section(d: Dialect, t: str) -> str:
    """Numbered or Roman section marks; any case, so words spelled of the letters of Roman numbers count too."""
    return "(" + " OR ".join([
        d.has(t, rf"^\d+(\.\d+)*{S}*[-–—:]?{S}+{W}"), d.has(t, rf"^\d+(\.\d+)*{S}*[-–—]?{S}*\z"), d.has(t, rf"^[ivxlcdmIVXLCDM]+(\.[ivxlcdmIVXLCDM]+)*{S}*[-–—:]?{S}+{W}"),
    ]) + ")"


def has_chapter(d: Dialect, t: str) -> str:
    return d.has(t, rf"^(cap[íi]tulo|se[çc][ãa]o|parte|anexo|ap[êe]ndice|chapter|section|part|appendix|annex){S}+", fold=True)


def has_structure(d: Dialect, t: str) -> str:
    names = (
        "introdu[çc][ãa]o|conclus[ãa]o|resumo|abstract|objetivos?|m[ée]todos?|resultados?|discuss[ãa]o|refer[êe]ncias?|bibliografia|agradecimentos?|sum[áa]rio|[íi]ndice|gloss[áa]rio"
        "|prefácio|introduction|conclusion|summary|methods?|results?|discussion|references?|acknowledgments?"
    )
    return d.has(t, rf"^({names}){S}*\z", fold=True)


def is_bullet(d: Dialect, t: str) -> str:
    return "(" + " OR ".join(d.has(t, p + f"{S}+") for p in (r"^[-•*▪▸►◦‣⁃]", r"^\(?[a-zA-Z]\)", r"^\d+[.)]", r"^[ivxlcdmIVXLCDM]+[.)]")) + ")"


def like_formula(d: Dialect, t: str) -> str:
    ops = r"[=+\-*/^∑∏∫√]"
    return f"({d.has(t, rf'{ops}[^\n]*{ops}')} OR {d.has(t, rf'^{S}*\([^\n]+\){S}*\z')})"


def numbers_only(d: Dialect, t: str) -> str:
    return d.has(t, rf"^[\d{S_IN}.,;:]+\z")


def punctuation_only(d: Dialect, t: str) -> str:
    return d.has(t, rf"^[{S_IN}.,;:!?\-–—()\[\]{{}}]+\z")


def code_like(d: Dialect, t: str) -> str:
    return d.has(t, r"^[A-Z]{2,5}\d{2,5}\z")


def valid_text(d: Dialect, t: str, least: int = 3) -> str:
    return f"(length({t}) >= {least} AND NOT {numbers_only(d, t)} AND NOT {punctuation_only(d, t)} AND NOT {code_like(d, t)} AND {d.has(t, r'\p{L}')})"


def fast_terms(d: Dialect, t: str, size: str, bold: str, body: str) -> list[tuple[str, int, str]]:
    """(condition, points, reason) of the fast strategy."""
    return [
        (has_section(d, t), 5, "section pattern"), (bold, 3, "bold"), (f"{size} - {body} > 1.5", 2, "larger than body"), (f"length({t}) > 120", -5, "too long"),
        (f"{d.last(t)} = '.'", -3, "ends with a full stop"), (is_bullet(d, t), -4, "bullet"),
    ]


def balanced_terms(d: Dialect, t: str, size: str, bold: str, body: str, before: str, after: str) -> list[tuple[str, int, str]]:
    """before, after: the neighbours' sizes, null at the ends."""
    return [
        *fast_terms(d, t, size, bold, body), (has_chapter(d, t), 4, "chapter word"), (has_structure(d, t), 3, "structural word"), (d.is_upper(d.first(t)), 1, "upper case"),
        (f"abs({size} - {body}) < 0.5 AND NOT {bold}", -3, "body size"),
        (f"coalesce({before}, 0) <> 0 AND coalesce({after}, 0) <> 0 AND abs({size} - {before}) < 0.5 AND abs({size} - {after}) < 0.5 AND NOT {bold}", -2, "in a sequence"),
        (d.is_lower(d.first(t)), -1, "lower case"),
    ]


def accurate_terms(d: Dialect, t: str, size: str, bold: str, body: str, before: str, after: str, y: str, ratio: str | None = None) -> list[tuple[str, int, str]]:
    """ratio: a column that holds stopword_ratio, if there is one."""
    ratio = ratio or stopword_ratio(d, t)
    lettered = d.count(t, rf"[^{S_IN}]*\p{{L}}[^{S_IN}]*")
    return [
        *balanced_terms(d, t, size, bold, body, before, after), (f"{ratio} > 0.35", -2, "stop words"), (f"{ratio} < 0.15", 1, "few stop words"),
        (f"length({t}) BETWEEN 10 AND 60", 1, "good length"), (f"length({t}) < 3", -3, "too short"), (code_like(d, t), -5, "header code"), (f"{d.times(t, '.')} > 1", -1, "full stops"),
        (f"{d.last(t)} = ':'", 1, "ends with a colon"), (f"{y} < 0.15", 1, "top of page"), (like_formula(d, t), -2, "like a formula"), (f"{word_count(d, t)} > 15", -1, "many words"),
        (d.has(f"replace(replace(replace({t}, ' ', ''), '.', ''), ',', '')", r"^\d+\z"), -5, "numbers only"), (f"{lettered} < 2 AND NOT {has_section(d, t)}", -1, "few words"),
    ]


def marks(terms: list[tuple[str, int, str]]) -> tuple[str, list[tuple[str, int, str]]]:
    """Columns k0, k1.. of the conditions, and the terms over these columns: each condition is worked out once."""
    return ", ".join(f"coalesce({c}, FALSE) AS k{i}" for i, (c, _, _) in enumerate(terms)), [(f"k{i}", p, r) for i, (_, p, r) in enumerate(terms)]


def points(d: Dialect, t: str, terms: list[tuple[str, int, str]]) -> str:
    """The sum of the points, -10 for text that can't head anything."""
    return f"CASE WHEN NOT {valid_text(d, t)} THEN -10 ELSE {d.total([(c, str(p)) for c, p, _ in terms])} END"


def reasons(d: Dialect, terms: list[tuple[str, int, str]]) -> str:
    """The reasons that hold, in order, joined by '; '."""
    each = [f"CASE WHEN {c} THEN {d.lit(f'{p:+d}: {r}')} ELSE '' END" for c, p, r in terms]
    return d.join(d.keep(d.array(*each), "s", "s <> ''"), "; ")


def quick_points(d: Dialect, t: str, size: str, bold: str, body: str) -> str:
    terms = [
        (has_section(d, t), 5), (has_chapter(d, t), 4), (has_structure(d, t), 3), (bold, 3), (f"{size} > {body} + 1.5", 2), (d.is_upper(d.first(t)), 1), (f"length({t}) > 120", -5),
        (f"{d.last(t)} = '.'", -3), (is_bullet(d, t), -4), (f"abs({size} - {body}) < 0.5 AND NOT {bold}", -3), (code_like(d, t), -5),
    ]
    return f"CASE WHEN NOT {valid_text(d, t)} THEN -10 ELSE {d.total([(c, str(p)) for c, p in terms])} END"


def span_level(d: Dialect, size: str, flags: str, font: str) -> str:
    """The Markdown formatter's level of a span: null where it isn't bold and above 14."""
    bold = f"(({flags} & 16) <> 0 OR contains(lower({font}), 'bold'))"
    return f"CASE WHEN {bold} AND {size} > 14 THEN CASE WHEN {size} > 24 THEN 1 WHEN {size} > 20 THEN 2 WHEN {size} > 18 THEN 3 ELSE 4 END END"


def span_markdown(d: Dialect, text: str, flags: str, font: str) -> str:
    bold = f"(({flags} & 16) <> 0 OR contains(lower({font}), 'bold'))"
    slant = f"(({flags} & 2) <> 0 OR contains(lower({font}), 'italic') OR contains(lower({font}), 'oblique'))"
    inner = f"CASE WHEN {bold} THEN concat('**', {text}, '**') ELSE {text} END"
    return f"CASE WHEN {slant} THEN concat('*', {inner}, '*') ELSE {inner} END"


def indent_level(d: Dialect, x: str) -> str:
    """The formatter's list level of raw text: 0 where it is no item."""
    p = rf"^({S}*)([-•*]|\d+(\.\d+)*\.){S}+"
    half = f"CAST(floor(length({d.group(x, p)}) / 2.0) AS INT)"
    return f"CASE WHEN {d.has(x, p)} THEN {half} + 1 ELSE 0 END"


def size_groups(d: Dialect, source: str, tolerance: str = "0.5") -> str:
    """doc_id, sizes: a document's sizes from the largest, without those within the tolerance of one that is kept."""
    sizes = f"SELECT doc_id, {d.gathered('font_size', '-font_size')} AS own FROM (SELECT DISTINCT doc_id, font_size FROM ({source}) AS z0) AS z1 GROUP BY doc_id"
    near = f"{d.size('acc')} > 0 AND {d.at('acc', '-1')} - x <= {tolerance}"
    return f"SELECT doc_id, {d.fold('own', d.doubles(), 'acc', 'x', f'CASE WHEN {near} THEN acc ELSE {d.append('acc', 'x')} END')} AS sizes FROM ({sizes}) AS z2"


def level_of_size(d: Dialect, size: str, sizes: str, tolerance: str = "0.5") -> str:
    """The place of the first of the six largest kept sizes within the tolerance; null if there is none."""
    fits = d.keep(d.numbers(f"least(6, {d.size(sizes)})"), "k", f"abs({size} - {d.at(sizes, 'k')}) <= {tolerance}")
    return f"CASE WHEN {d.size(fits)} > 0 THEN {d.at(fits, '1')} END"


def filtered(d: Dialect, source: str, valid: str) -> str:
    """doc_id, block_idx, page_num, text, level, font_size: headings by the filter's rules.

    Levels come from the sizes of the valid candidates (10 to 72 points, first of their text); every candidate with
    valid text, outside the margins, not generic, is then looked up again, whatever its size, and the first heading of
    each text stays. valid: SQL of doc_id, block_idx, norm of the valid candidates.
    """
    ok = f"length(text) BETWEEN 2 AND 200 AND {d.has('lower(text)', '[a-záéíóúàâãñ]')} AND NOT (y_ratio < 0.05 OR y_ratio > 0.92)"
    norm = "lower(" + d.sub("text", f"{S}+", " ") + ")"
    own = f"SELECT b.doc_id, b.font_size FROM ({source}) AS b JOIN (SELECT doc_id AS vd, block_idx AS vb FROM ({valid}) AS v0) AS v ON vd = b.doc_id AND vb = b.block_idx"
    groups = f"SELECT doc_id AS gd, sizes FROM ({size_groups(d, own)}) AS g0"
    cand = f"SELECT * FROM ({d.once(f'SELECT * FROM ({source}) AS c0 WHERE {ok}', norm=norm)}) AS c WHERE NOT {d.member('norm', GENERIC)}"
    levels = f"SELECT c.*, {level_of_size(d, 'font_size', 'sizes')} AS level FROM ({cand}) AS c JOIN ({groups}) AS g ON gd = doc_id"
    first = f"SELECT *, row_number() OVER (PARTITION BY doc_id, norm ORDER BY block_idx) AS k FROM ({levels}) AS l WHERE level IS NOT NULL"
    return f"SELECT doc_id, block_idx, page_num, text, CAST(level AS INT) AS level, font_size FROM ({first}) AS f WHERE k = 1"


def filter_statistics(d: Dialect, source: str, valid: str) -> str:
    """Per document: candidates, valid ones, headings, different levels."""
    n = f"SELECT doc_id, count(*) AS candidates FROM ({source}) AS s GROUP BY doc_id"
    v = f"SELECT doc_id AS vd, count(*) AS valid FROM ({valid}) AS v0 GROUP BY doc_id"
    h = f"SELECT doc_id AS hd, count(*) AS headings, count(DISTINCT level) AS levels FROM ({filtered(d, source, valid)}) AS h0 GROUP BY doc_id"
    return f"SELECT doc_id, candidates, coalesce(valid, 0) AS valid, coalesce(headings, 0) AS headings, coalesce(levels, 0) AS levels FROM ({n}) AS n LEFT JOIN ({v}) AS v ON vd = doc_id LEFT JOIN ({h}) AS h ON hd = doc_id"
