"""The Markdown formatter: events of a document in order as blocks, and blocks as one text.

events: doc_id, seq, kind, text, level, path. Kinds: span (a piece of the paragraph being gathered, with its marks),
end (of a paragraph), heading, item, image (text is its caption), break. Everything but spans and items ends the
paragraph; items stand before a paragraph that is still open.
"""

from __future__ import annotations

from leafwork.functions.dialect import Dialect


def blocks(d: Dialect, events: str) -> str:
    """doc_id, place, kind, content of the blocks: paragraphs without separators between their spans, the others by their
    marks; blank ones are left out, and so is a break at the start or after another one."""
    ends = "CASE WHEN kind IN ('end', 'heading', 'image', 'break') THEN 1 ELSE 0 END"
    before = f"SELECT *, coalesce(sum({ends}) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM ({events}) AS e"
    # a paragraph stands where its end does; the last one at the document's end
    closed = f"SELECT doc_id AS cd, part AS cp, min(seq) AS closed FROM ({before}) AS b0 WHERE kind IN ('end', 'heading', 'image', 'break') GROUP BY doc_id, part"
    spans = f"SELECT doc_id, part, {d.strip(d.gather('text', 'seq', d.lit('')))} AS content FROM ({before}) AS b1 WHERE kind = 'span' AND {d.strip('text')} <> '' GROUP BY doc_id, part"
    paragraphs = f"SELECT doc_id, CASE WHEN closed IS NULL THEN 2000000001 ELSE 2 * closed END AS place, 'paragraph' AS kind, content FROM ({spans}) AS s LEFT JOIN ({closed}) AS c ON cd = doc_id AND cp = part WHERE content <> ''"
    t = d.strip("text")
    marked = (
        f"CASE kind WHEN 'heading' THEN concat(repeat('#', level), ' ', {t}) WHEN 'item' THEN concat(repeat('  ', level - 1), '- ', {t})"
        f" WHEN 'image' THEN concat('![', text, '](', path, ')') ELSE '---' END"
    )
    others = f"SELECT doc_id, 2 * seq + 1 AS place, kind, {marked} AS content FROM ({events}) AS o WHERE kind IN ('image', 'break') OR (kind IN ('heading', 'item') AND {t} <> '')"
    both = f"SELECT *, lag(content) OVER (PARTITION BY doc_id ORDER BY place) AS last FROM (SELECT * FROM ({paragraphs}) AS p UNION ALL SELECT * FROM ({others}) AS q) AS r"
    return f"SELECT doc_id, place, kind, content FROM ({both}) AS k WHERE kind <> 'break' OR (last IS NOT NULL AND {d.strip('last')} <> '---')"


def document(d: Dialect, events: str) -> str:
    """doc_id, markdown: the blocks line by line, a blank line after paragraphs and images, at most one in a row."""
    line = f"CASE WHEN kind IN ('paragraph', 'image') THEN concat(content, {d.newline()}) ELSE content END"
    joined = f"SELECT doc_id, {d.gather(line, 'place', d.newline())} AS body FROM ({blocks(d, events)}) AS b GROUP BY doc_id"
    squeezed = d.sub("body", "\\n\\n\\n+", "\n\n")
    return f"SELECT doc_id, {d.strip(squeezed)} AS markdown FROM ({joined}) AS j"
