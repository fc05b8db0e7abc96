"""Figure, table, frame and chart mentions that lead nowhere, and their removal."""

from __future__ import annotations

from leafwork.functions.dialect import Dialect, S

# The forms of a mention by kind.
FORMS = {
    "figure": [rf"\*Figura{S}+\d+\*", rf"\*\*Figura{S}+\d+\*\*", rf"Figura{S}+\d+[:.]?", rf"Fig\.{S}*\d+[:.]?", rf"\(Figura{S}+\d+\)", rf"\[Figura{S}+\d+\]"],
    "table": [rf"\*Tabela{S}+\d+\*", rf"\*\*Tabela{S}+\d+\*\*", rf"Tabela{S}+\d+[:.]?", rf"Tab\.{S}*\d+[:.]?"],
    "frame": [rf"\*Quadro{S}+\d+\*", rf"Quadro{S}+\d+[:.]?"],
    "chart": [rf"\*Gráfico{S}+\d+\*", rf"Gráfico{S}+\d+[:.]?", rf"Graf\.{S}*\d+[:.]?"],
}
FIGURES = FORMS["figure"][:4]


_HINT = r"(fig|tab|quadro|gr[aá]f)[^\d]*\d"  # what any mention holds; a line without it has none


def _found(d: Dialect, forms: dict[str, list[str]]) -> list[str]:
    """Arrays of (kind, form_no, mention), one for each form."""
    every = [(k, p) for k, ps in forms.items() for p in ps]
    return [d.each(d.all("text", p, 0, fold=True), "m", d.record(kind=d.lit(k), no=str(n), m="m")) for n, (k, p) in enumerate(every)]


def mentions(d: Dialect, source: str, forms: dict[str, list[str]] = FORMS) -> str:
    """doc_id, block_idx, text, ref_type, form_no, mention: every match of every form in each line; one reading of the lines."""
    rows = f"SELECT doc_id, block_idx, text, {d.rows(*_found(d, forms))} AS r FROM ({source}) AS s WHERE {d.has('text', _HINT, fold=True)}"
    return f"SELECT doc_id, block_idx, text, r.kind AS ref_type, r.no AS form_no, r.m AS mention FROM ({rows}) AS a"


def orphans(d: Dialect, source: str, images: str | None = None) -> str:
    """Mentions that are their line, or leave fewer than 5 characters of it, or (with images: doc_id, path) whose number is in no path of the document."""
    m = f"SELECT doc_id, block_idx, {d.strip('text')} AS text, ref_type, form_no, mention, {d.strip('mention')} AS own FROM ({mentions(d, source)}) AS a"
    left = f"length({d.strip(_without(d))}) < 5"
    alone = f"text = own OR {left}"
    if images is None:
        return f"SELECT doc_id, block_idx, ref_type, form_no, mention FROM ({m}) AS b WHERE {alone}"
    number = d.group("mention", r"(\d+)")
    n = f"SELECT *, {number} AS number FROM ({m}) AS b"
    hit = f"SELECT DISTINCT n1.doc_id AS hd, n1.number AS hn FROM (SELECT DISTINCT doc_id, number FROM ({n}) AS n0) AS n1 JOIN ({images}) AS i ON i.doc_id = n1.doc_id AND contains(path, number)"
    return f"SELECT doc_id, block_idx, ref_type, form_no, mention FROM ({n}) AS n LEFT JOIN ({hit}) AS h ON hd = doc_id AND hn = number WHERE {alone} OR hd IS NULL"


def _without(d: Dialect) -> str:
    return "replace(text, own, '')"


def context(d: Dialect, source: str) -> str:
    """Each line with the two before and after it, numbered."""
    w = "OVER (PARTITION BY doc_id ORDER BY block_idx)"
    line = "concat(CAST(block_idx + 1 AS VARCHAR(12)), ': ', text)" if not d.spark else "concat(CAST(block_idx + 1 AS STRING), ': ', text)"
    n = f"SELECT doc_id, block_idx, {line} AS line FROM ({source}) AS s"
    parts = [f"lag(line, {k}) {w}" for k in (2, 1)] + ["line"] + [f"lead(line, {k}) {w}" for k in (1, 2)]
    cols = ", ".join(f"{p} AS c{k}" for k, p in enumerate(parts))
    return f"SELECT doc_id, block_idx, concat_ws({d.newline()}, c0, c1, c2, c3, c4) AS context FROM (SELECT doc_id, block_idx, {cols} FROM ({n}) AS n) AS c"


def cleaned_lines(d: Dialect, source: str) -> str:
    """Lines without their orphans: one after the other, in the order of the forms, a mention that is the whole line takes
    the line with it, any other goes and leaves its line's rest. The others stay as they are."""
    every = f"flatten({d.array(*_found(d, FORMS))})"
    own = lambda m: d.strip(m)
    lost = d.keep("found", "r", f"stripped = {own('r.m')} OR length({d.strip('replace(stripped, ' + own('r.m') + ', ' + repr('') + ')')}) < 5")
    marked = d.once(f"SELECT *, {d.strip('text')} AS stripped FROM ({source}) AS s", found=f"CASE WHEN {d.has('text', _HINT, fold=True)} THEN {every} END")
    hit = f"SELECT *, {lost} AS lost FROM ({marked}) AS m"
    gone = d.lit("\ufdd0")  # a code point that no text holds
    rest = d.fold(d.each("lost", "r", "r.m"), "text", "acc", "m", f"CASE WHEN acc = {gone} OR {d.strip('acc')} = {own('m')} THEN {gone} ELSE {d.strip('replace(acc, m, ' + repr('') + ')')} END")
    left = f"CASE WHEN coalesce({d.size('lost')}, 0) > 0 THEN {rest} ELSE text END"
    return f"SELECT doc_id, block_idx, text, orphans FROM (SELECT doc_id, block_idx, {left} AS text, greatest(coalesce({d.size('lost')}, 0), 0) AS orphans FROM ({hit}) AS h) AS k WHERE text <> {gone}"


def cleaned(d: Dialect, source: str) -> str:
    """doc_id, content, removed: whole documents without their orphans, at most one blank line in a row and none around;
    a document without orphans stays as it is. source: all lines, blank ones too, unstripped."""
    lines = f"SELECT doc_id, {d.gather('text', 'block_idx', d.newline())} AS content, sum(orphans) AS part FROM ({cleaned_lines(d, source)}) AS l GROUP BY doc_id"
    whole = f"SELECT doc_id AS w, {d.gather('text', 'block_idx', d.newline())} AS before FROM ({source}) AS b GROUP BY doc_id"
    removed = f"SELECT doc_id AS r, count(*) AS n FROM ({orphans(d, source)}) AS o GROUP BY doc_id"
    tidy = d.strip(d.sub("coalesce(content, '')", r"\n{3,}", "\n\n"))
    return f"SELECT w AS doc_id, CASE WHEN n IS NULL THEN before ELSE {tidy} END AS content, coalesce(n, 0) AS removed FROM ({whole}) AS a LEFT JOIN ({lines}) AS c ON w = doc_id LEFT JOIN ({removed}) AS x ON w = r"


def image_names(d: Dialect, source: str) -> str:
    """doc_id, name: the different paths and captions of the images that Markdown lines show."""
    pair = r"!\[([^\]]*)\]\(([^)]+)\)"
    rows = f"SELECT doc_id, {d.rows(d.all('text', pair, 1), d.all('text', pair, 2))} AS name FROM ({source}) AS s WHERE contains(text, '![')"
    return f"SELECT DISTINCT doc_id, name FROM ({rows}) AS n WHERE name <> ''"


def has_orphan_figures(d: Dialect, source: str, n_images: int = 0) -> str:
    """doc_id, n_refs, orphaned: more than two mentions of figures for each image."""
    m = f"SELECT doc_id, count(*) AS n_refs FROM ({mentions(d, source, {'figure': FIGURES})}) AS f GROUP BY doc_id"
    return f"SELECT doc_id, n_refs, n_refs > {2 * n_images} AS orphaned FROM ({m}) AS g"
