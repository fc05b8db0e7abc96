"""List items: recognition, parts, Markdown, lists within a line."""

from __future__ import annotations

from leafwork.functions.dialect import Dialect, S, S_IN

# Characters that start an item.
BULLETS = "•◦○●■□▪▫‣⁃→➤➢►▶★☆✦✧-–—−*"
CHECKBOXES = "☐☑☒✓✗✔✘□■"
SPECIAL = "•‣●○■□"
ROMANS = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x")

SECTION = rf"^\d+{S}*\.{S}*\d+"
NUMBERED = rf"^(\d{{1,3}})[)\-]{S}+([^\n]+)\n?\z"
DOTTED = rf"^(\d{{1,3}})\.{S}+([A-Za-z][^\n]*)\n?\z"
TITLED = rf"^\d{{1,3}}\.{S}+[A-Z][a-z]*{S}*[-–—]"
LETTERED = rf"^([a-zA-Z])[.)]{S}*([^\n]*)\n?\z"
ROMAN = rf"^([ivxIVX]{{1,4}})[.)]{S}*([^\n]*)\n?\z"


def _in(d: Dialect, c: str, names: str) -> str:
    return f"({c} <> '' AND instr({d.lit(names)}, {c}) > 0)"


def is_list_item(d: Dialect, t: str) -> str:
    """t: stripped text. A section number is never an item; a letter or Roman number needs no space behind its mark."""
    c = d.first(t)
    return (
        f"(length({t}) >= 2 AND ({_in(d, c, BULLETS)} OR {_in(d, c, SPECIAL)} OR {_in(d, c, CHECKBOXES)} OR (NOT {d.has(t, SECTION)} AND ({d.has(t, NUMBERED)}"
        f" OR ({d.has(t, DOTTED)} AND NOT {d.has(t, TITLED)}) OR {d.has(t, LETTERED)} OR {d.has(t, ROMAN)}))))"
    )


def list_parts(d: Dialect, t: str) -> tuple[str, str, str]:
    """(type, marker, content) of stripped text; type none, empty marker and the text itself where it is no item."""
    c = d.first(t)
    body = d.strip(d.sub(d.strip(f"substr({t}, 2)"), rf"^[{S_IN}\-–—:]+"))
    start = [(_in(d, c, CHECKBOXES), "checkbox"), (f"({_in(d, c, SPECIAL)} OR {_in(d, c, BULLETS)})", "bullet")]
    roman = f"({d.has(t, ROMAN)} AND {d.member(f'lower({d.group(t, ROMAN)})', ROMANS)})"
    marked = [
        (d.has(t, SECTION), "none", None), (d.has(t, NUMBERED), "numbered", NUMBERED), (f"({d.has(t, DOTTED)} AND NOT {d.has(t, TITLED)})", "numbered", DOTTED),
        (d.has(t, LETTERED), "lettered", LETTERED), (roman, "roman", ROMAN),
    ]
    case = lambda pairs, other: "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in pairs) + f" ELSE {other} END"
    kind = case([(a, f"'{b}'") for a, b in start] + [(a, f"'{b}'") for a, b, _ in marked], "'none'")
    mark = case([(a, c) for a, _ in start] + [(a, d.group(t, p) if p else "''") for a, _, p in marked], "''")
    content = case([(a, body) for a, _ in start] + [(a, d.strip(d.group(t, p, 2)) if p else t) for a, _, p in marked], t)
    return kind, mark, content


def list_markdown(d: Dialect, t: str, kind: str, mark: str, content: str, level: int = 0) -> str:
    """The item as Markdown, two spaces in for each level; text that is no item stays."""
    pad = "'" + "  " * level + "'"
    return (
        f"CASE {kind} WHEN 'none' THEN {t} WHEN 'numbered' THEN concat({pad}, {mark}, '. ', {content}) WHEN 'lettered' THEN concat({pad}, {mark}, ') ', {content})"
        f" WHEN 'roman' THEN concat({pad}, {mark}, '. ', {content}) ELSE concat({pad}, '- ', {content}) END"
    )


INLINE = rf"([^:]+):{S}{{2,}}([^;]+(;{S}{{2,}}[^;]+)+;?){S}*\z"


def _inline(d: Dialect, x: str) -> str:
    """Whether INLINE is found in x. Its marks are looked for first: the pattern alone tries every start in a long text."""
    return f"(contains({x}, ':') AND contains({x}, ';') AND {d.has(x, rf':{S}{{2,}}[^;]+;{S}{{2,}}')} AND {d.has(x, INLINE)})"


def has_inline_list(d: Dialect, x: str) -> str:
    return f"(length({x}) >= 20 AND ({_inline(d, x)} OR ({d.times(x, ';')} >= 3 AND {d.count(x, rf'{S}{{2,}}[^;]+;')} >= 2)))"


def inline_parts(d: Dialect, x: str) -> tuple[str, str]:
    """(intro, items) of text with a list in it (has_inline_list); else the text and no items."""
    filled = lambda items: d.keep(d.each(items, "s", d.strip("s")), "s", "s <> ''")
    rest = d.strip(f"substr({x}, instr({x}, ':') + 1)")
    loose = filled(d.each(d.split(rest, rf"{S}{{2,}}"), "s", d.sub(d.strip("s"), r";+\z")))
    close = filled(d.split(d.group(x, INLINE, 2), rf";{S}*"))
    empty = "CAST(array() AS ARRAY<STRING>)" if d.spark else "CAST([] AS VARCHAR[])"
    split = f"{has_inline_list(d, x)} AND instr({x}, ':') > 1 AND {d.size(loose)} >= 2"
    intro = f"CASE WHEN {_inline(d, x)} THEN {d.strip(d.group(x, INLINE))} WHEN {split} THEN {d.strip(f'substr({x}, 1, instr({x}, chr(58)) - 1)')} ELSE {x} END"
    return intro, f"CASE WHEN {_inline(d, x)} THEN {close} WHEN {split} THEN {loose} ELSE {empty} END"


def inline_markdown(d: Dialect, x: str, intro: str, items: str, listed: str | None = None) -> str:
    """Lines of a paragraph: its intro, a blank line and an item a line where it holds a list, else the text."""
    nl = d.newline()
    lines = d.each(items, "s", "concat('- ', s)")
    joined = f"array_join({lines}, {nl})" if d.spark else f"array_to_string({lines}, {nl})"
    return f"CASE WHEN {listed or has_inline_list(d, x)} AND {d.size(items)} >= 2 THEN concat(CASE WHEN {intro} <> '' THEN concat({intro}, ':', {nl}, {nl}) ELSE '' END, {joined}) ELSE {x} END"
