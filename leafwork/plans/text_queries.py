"""Queries of the text, list, heading and paragraph operators over the lines of documents and of the fixture."""

from __future__ import annotations

from leafwork.functions import formatter, headings as H, lists as L, text as T
from leafwork.functions.dialect import Dialect
from leafwork.operators import paragraphs
from leafwork.sources.blocks import blocks

_KEY = "doc_id, block_idx"


def per_line(*columns):
    """A spec: key and named expressions over each block; columns are (name, d -> SQL over text, raw, font_size, bold, y_ratio)."""
    return lambda d: f"SELECT {_KEY}, {', '.join(f'{make(d)} AS {name}' for name, make in columns)} FROM ({blocks(d)}) AS b"


def _list_item_type(d: Dialect) -> str:
    k, m, c = L.list_parts(d, "text")
    return f"SELECT {_KEY}, {L.is_list_item(d, 'text')} AS is_item, {k} AS list_type, {m} AS marker, {c} AS content FROM ({blocks(d)}) AS b"


def _list_markdown(d: Dialect) -> str:
    k, m, c = L.list_parts(d, "text")
    typed = f"SELECT *, {k} AS k, {m} AS m, {c} AS c FROM ({blocks(d)}) AS b"
    return f"SELECT {_KEY}, {L.list_markdown(d, 'text', 'k', 'm', 'c')} AS item, {L.list_markdown(d, 'text', 'k', 'm', 'c', 2)} AS item_in FROM ({typed}) AS t"


def _inline_list(d: Dialect) -> str:
    intro, items = L.inline_parts(d, "text")
    typed = f"SELECT *, {intro} AS intro, {items} AS items FROM ({blocks(d)}) AS b"
    return f"SELECT {_KEY}, {L.has_inline_list(d, 'text')} AS has_list, intro, {d.size('items')} AS n_items, {L.inline_markdown(d, 'text', 'intro', 'items')} AS markdown FROM ({typed}) AS t"


def _list_runs(d: Dialect) -> str:
    """Runs of consecutive items; a run that isn't the document's end is followed by a blank line."""
    flagged = f"SELECT *, {L.is_list_item(d, 'text')} AS item FROM ({blocks(d)}) AS b"
    runs = f"SELECT *, sum(CASE WHEN item THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY block_idx) AS run, lead(text) OVER (PARTITION BY doc_id ORDER BY block_idx) IS NULL AS ends FROM ({flagged}) AS f"
    return f"SELECT doc_id, run, count(*) AS n_items, min(block_idx) AS first_block, NOT max(CASE WHEN ends THEN 1 ELSE 0 END) = 1 AS blank_after FROM ({runs}) AS r WHERE item GROUP BY doc_id, run"


def body_sizes(d: Dialect, source: str) -> str:
    """doc_id, body (the commonest size to half points; the first seen at a tie), sizes (body sizes, each over 8 % and of the three commonest)."""
    rounded = f"SELECT doc_id, block_idx, {d.half_even('font_size * 2')} / 2 AS size FROM ({source}) AS s0"
    counted = f"SELECT doc_id, size, count(*) AS n, min(block_idx) AS seen FROM ({rounded}) AS s1 GROUP BY doc_id, size"
    return f"SELECT doc_id, size, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, seen) AS place, sum(n) OVER (PARTITION BY doc_id) AS total FROM ({counted}) AS s2"


def _body_font_size(d: Dialect) -> str:
    return f"SELECT doc_id, max(CASE WHEN place = 1 THEN size END) AS body_size, sum(CASE WHEN place <= 3 AND n > 0.08 * total THEN 1 ELSE 0 END) AS n_body_sizes FROM ({body_sizes(d, blocks(d))}) AS s GROUP BY doc_id"


def size_levels(d: Dialect, source: str) -> str:
    """doc_id, size, level: sizes that are bold or above body + 1.5, without body sizes, the six largest."""
    stats = body_sizes(d, source)
    body = f"SELECT doc_id AS bd, max(CASE WHEN place = 1 THEN size END) AS body FROM ({stats}) AS q0 GROUP BY doc_id"
    rounded = f"SELECT doc_id, {d.half_even('font_size * 2')} / 2 AS size, bold FROM ({source}) AS q1"
    cand = f"SELECT DISTINCT doc_id, size FROM ({rounded}) AS q2 JOIN ({body}) AS q3 ON doc_id = bd WHERE size > body + 1.5 OR bold"
    common = f"SELECT doc_id AS cd, size AS cs FROM ({stats}) AS q4 WHERE place <= 3 AND n > 0.08 * total"
    free = f"SELECT doc_id, size FROM ({cand}) AS q5 LEFT JOIN ({common}) AS q6 ON cd = doc_id AND cs = size WHERE cd IS NULL"
    return f"SELECT * FROM (SELECT doc_id, size, dense_rank() OVER (PARTITION BY doc_id ORDER BY size DESC) AS level FROM ({free}) AS q7) AS q8 WHERE level <= 6"


def scored(d: Dialect, strategy: str, source: str) -> str:
    """Blocks with score, is_heading (4 points or more) and reasons; neighbours are the document's lines before and after."""
    sized = f"SELECT *, {d.half_even('font_size * 2')} / 2 AS size FROM ({source}) AS e0"
    counted = f"SELECT *, count(*) OVER (PARTITION BY doc_id, size) AS size_n, min(block_idx) OVER (PARTITION BY doc_id, size) AS size_seen FROM ({sized}) AS e1"
    row = "OVER (PARTITION BY doc_id ORDER BY block_idx)"
    near = f"SELECT *, first_value(size) OVER (PARTITION BY doc_id ORDER BY size_n DESC, size_seen) AS body, lag(font_size) {row} AS size_before, lead(font_size) {row} AS size_after FROM ({counted}) AS e6"
    base = ("text", "font_size", "bold", "body")
    terms = {
        "fast": lambda: H.fast_terms(d, *base), "balanced": lambda: H.balanced_terms(d, *base, "size_before", "size_after"),
        "accurate": lambda: H.accurate_terms(d, *base, "size_before", "size_after", "y_ratio", "stops"),
    }[strategy]()
    if strategy == "accurate":
        near = f"SELECT *, {H.stopword_ratio(d, 'text')} AS stops FROM ({near}) AS e5"
    columns, terms = H.marks(terms)
    near = f"SELECT *, {columns} FROM ({near}) AS e4"
    return f"SELECT *, score >= 4 AS is_heading FROM (SELECT *, {H.points(d, 'text', terms)} AS score, {H.reasons(d, terms)} AS reasons FROM ({near}) AS e2) AS e3"


def _score(strategy: str):
    return lambda d: f"SELECT {_KEY}, score, is_heading, reasons FROM ({scored(d, strategy, blocks(d))}) AS z"


def _heading_level_lookup(d: Dialect) -> str:
    """Level of each heading: its size's, else the nearest size's within 1 point (the larger at a tie), else 4."""
    heads = f"SELECT doc_id, block_idx, text, font_size FROM ({scored(d, 'balanced', blocks(d))}) AS h0 WHERE is_heading"
    near = f"SELECT h.*, level, row_number() OVER (PARTITION BY h.doc_id, block_idx ORDER BY abs(size - font_size), size DESC) AS place FROM ({heads}) AS h LEFT JOIN ({size_levels(d, blocks(d))}) AS v ON v.doc_id = h.doc_id AND abs(size - font_size) < 1"
    return f"SELECT doc_id, block_idx, text, coalesce(level, 4) AS level FROM ({near}) AS n WHERE place = 1"


def _heading_filter(d: Dialect) -> str:
    """The filter's candidates: size 10 to 72, a letter, 2 to 200 characters, no generic title, not in a margin; first of its text in the document."""
    norm = f"lower({T_norm(d)})"
    ok = f"font_size BETWEEN 10 AND 72 AND length(text) BETWEEN 2 AND 200 AND {d.has('lower(text)', '[a-záéíóúàâãñ]')} AND NOT (y_ratio < 0.05 OR y_ratio > 0.92)"
    valid = f"SELECT * FROM (SELECT *, {norm} AS norm FROM ({blocks(d)}) AS b WHERE {ok}) AS v WHERE NOT {d.member('norm', H.GENERIC)}"
    return f"SELECT doc_id, block_idx, norm FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, norm ORDER BY block_idx) AS k FROM ({valid}) AS w) AS x WHERE k = 1"


def T_norm(d: Dialect) -> str:
    from leafwork.functions.dialect import S

    return d.sub("text", f"{S}+", " ")


def _repeated_lines(d: Dialect) -> str:
    return f"SELECT {_KEY}, repeat_key FROM ({paragraphs.without_repeats(d, blocks(d))}) AS r"


def _text_type(d: Dialect) -> str:
    s = f"SELECT *, {T.formula_hundredths(d, 'text')} AS formula_score FROM ({blocks(d)}) AS b"
    return f"SELECT {_KEY}, formula_score, {T.text_type(d, 'text', 'formula_score')} AS text_type FROM ({s}) AS s"


def _formula_continuation(d: Dialect) -> str:
    """Whether a line continues the formula before it: an operator at the joint, or both look like formulas."""
    s = f"SELECT *, {T.formula_hundredths(d, 'text')} AS s FROM ({blocks(d)}) AS b"
    n = f"SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY block_idx) AS t0, lag(s) OVER (PARTITION BY doc_id ORDER BY block_idx) AS s0 FROM ({s}) AS s"
    ops = r"[+\-*/=<>]"
    return f"SELECT {_KEY}, coalesce({d.has(d.last('t0'), ops)} OR (t0 IS NOT NULL AND {d.has(d.first('text'), ops)}) OR (s0 > 50 AND s > 30), FALSE) AS continues FROM ({n}) AS n"


def _clean_artifacts(d: Dialect) -> str:
    c = f"SELECT *, {T.clean_text(d, 'text')} AS cleaned FROM ({blocks(d)}) AS b"
    return f"SELECT {_KEY}, {T.clean_artifacts(d, 'cleaned')} AS kept FROM ({c}) AS c"


def _size_groups(d: Dialect) -> str:
    return f"SELECT doc_id, {d.size('sizes')} AS n_sizes, {d.at('sizes', '1')} AS largest, {d.at('sizes', '-1')} AS smallest FROM ({H.size_groups(d, blocks(d))}) AS g"


def events(d: Dialect, source: str) -> str:
    """Blocks as the formatter's events: breaks between pages, headings and items by their marks, now and then an image; a full stop ends a paragraph."""
    span = H.span_markdown(d, "text", "font_flags", "'Times'")
    kind = f"CASE WHEN block_idx % 17 = 11 THEN 'image' WHEN block_idx % 30 = 0 AND bold THEN 'heading' WHEN {H.indent_level(d, 'raw')} > 0 THEN 'item' ELSE 'span' END"
    typed = d.once(source, kind=kind, item_level=H.indent_level(d, "raw"), shown=span)
    path = "concat('images/page', CAST(page_num AS STRING), '.png')" if d.spark else "concat('images/page', CAST(page_num AS VARCHAR), '.png')"
    own = f"SELECT doc_id, 3 * block_idx + 1 AS seq, kind, CASE WHEN kind = 'span' THEN shown ELSE text END AS text, CASE kind WHEN 'heading' THEN 2 WHEN 'item' THEN item_level ELSE 0 END AS level, CASE WHEN kind = 'image' THEN {path} END AS path FROM ({typed}) AS t"
    ends = f"SELECT doc_id, 3 * block_idx + 2 AS seq, 'end' AS kind, '' AS text, 0 AS level, NULL AS path FROM ({source}) AS e WHERE {d.last('text')} = '.'"
    breaks = f"SELECT doc_id, 3 * min(block_idx) AS seq, 'break' AS kind, '' AS text, 0 AS level, NULL AS path FROM ({source}) AS p GROUP BY doc_id, page_num"
    return f"SELECT * FROM ({own}) AS o UNION ALL SELECT * FROM ({ends}) AS x UNION ALL SELECT * FROM ({breaks}) AS y"


SPECS = {
    "content_hash": lambda d: "SELECT doc_id, md5(coalesce(text, '')) AS hash FROM @documents@",
    "heading_size_groups": _size_groups,
    "heading_filter_levels": lambda d: H.filtered(d, blocks(d), _heading_filter(d)),
    "heading_filter_stats": lambda d: H.filter_statistics(d, blocks(d), _heading_filter(d)),
    "formatter_blocks": lambda d: formatter.blocks(d, events(d, blocks(d))),
    "formatter_markdown": lambda d: formatter.document(d, events(d, blocks(d))),
    "clean_text": per_line(("cleaned", lambda d: T.clean_text(d, "raw"))),
    "pua_to_unicode": per_line(("shown", lambda d: T.symbols_to_text(d, "raw"))),
    "page_artifacts": per_line(("kept", lambda d: T.page_artifacts(d, "raw"))),
    "normalize_whitespace": per_line(("kept", lambda d: T.whitespace(d, "raw"))),
    "control_chars": per_line(("kept", lambda d: T.control_chars(d, "raw"))),
    "header_footer_flag": per_line(("furniture", lambda d: T.is_page_furniture(d, "text")), ("margin", lambda d: T.is_margin_text(d, "text"))),
    "repeated_lines": _repeated_lines,
    "garbage_flag": per_line(("garbage", lambda d: T.is_garbage(d, "raw"))),
    "clean_pdf_artifacts": _clean_artifacts,
    "text_type": _text_type,
    "formula_continuation": _formula_continuation,
    "equation_label": per_line(("bare", lambda d: T.equation_label(d, "text")[0]), ("label", lambda d: T.equation_label(d, "text")[1])),
    "list_item_type": _list_item_type,
    "list_markdown": _list_markdown,
    "inline_list": _inline_list,
    "list_runs": _list_runs,
    "formatter_list_level": per_line(("level", lambda d: H.indent_level(d, "raw"))),
    "stopword_ratio": per_line(("ratio", lambda d: f"round({H.stopword_ratio(d, 'text')}, 9)")),
    "heading_predicates": per_line(
        ("section", lambda d: H.has_section(d, "text")), ("chapter", lambda d: H.has_chapter(d, "text")), ("structure", lambda d: H.has_structure(d, "text")), ("bullet", lambda d: H.is_bullet(d, "text")),
        ("formula", lambda d: H.like_formula(d, "text")), ("numbers", lambda d: H.numbers_only(d, "text")), ("punctuation", lambda d: H.punctuation_only(d, "text")), ("code", lambda d: H.code_like(d, "text")),
        ("valid", lambda d: H.valid_text(d, "text")),
    ),
    "body_font_size": _body_font_size,
    "body_size_set": lambda d: f"SELECT doc_id, size, n, place FROM ({body_sizes(d, blocks(d))}) AS s WHERE place <= 3 AND n > 0.08 * total",
    "size_levels": lambda d: size_levels(d, blocks(d)),
    "heading_score_fast": _score("fast"),
    "heading_score_balanced": _score("balanced"),
    "heading_score_accurate": _score("accurate"),
    "heading_quick_score": per_line(("score", lambda d: H.quick_points(d, "text", "font_size", "bold", "12"))),
    "heading_level_lookup": _heading_level_lookup,
    "heading_filter_valid": _heading_filter,
    "heading_candidate": per_line(("candidate", lambda d: T.is_heading_candidate(d, "text", "font_size"))),
    "heading_level_rules": per_line(("level", lambda d: T.heading_level(d, "text", "font_size"))),
    "paragraph_kinds": lambda d: f"SELECT {_KEY}, page_num, kind, brk FROM ({paragraphs.marked(d, blocks(d))}) AS m",
    "paragraph_units": lambda d: f"SELECT doc_id, page_num, unit, kind, body FROM ({paragraphs.units(d, blocks(d))}) AS u",
    "page_assembly": lambda d: paragraphs.page_markdown(d, blocks(d)),
    "paragraph_markdown": lambda d: paragraphs.document_markdown(d, blocks(d)),
    "titled_markdown": lambda d: paragraphs.document_markdown(d, blocks(d), title="concat('document ', CAST(doc_id AS VARCHAR(20)))" if not d.spark else "concat('document ', CAST(doc_id AS STRING))"),
    "safe_filename": lambda d: f"SELECT page_id, {T.safe_filename(d, 'url')} AS name FROM @pages@",
}
