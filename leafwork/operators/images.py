"""Images on pages: numbering, duplicates, relevance, references to them, placing; geometry predicates.

images: doc_id, page_num, img_no, path, md5, x0, y0, x1, y1, std_mean (mean channel deviation, null if unknown).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from leafwork.functions.dialect import Dialect, S
from leafwork.operators.notation import python_column

# The words for figures and their kinds, the words by which an image's page is known, and a page's default size.
REFERENCES = [
    (r"figura|fig\.?", "figura"), (r"tabela|tab\.?", "tabela"), (r"imagem|img\.?", "imagem"), (r"gráfico|gráf\.?", "gráfico"), (r"figure|fig\.?", "figure"), (r"table|tbl\.?", "table"), (r"image|img\.?", "image"), ("chart|graph", "chart"),
]
MENTIONS = [r"figura|fig\.?", r"tabela|tab\.?", r"imagem|img\.?", r"gráfico|gráf\.?", r"chart|figure|fig\.?", r"table|tbl\.?", r"image|img\.?"]
_HINT = r"(fig|tab|im|gr|chart|tbl)[^\d]*\d"  # what any of them holds; a line without it has none
PAGE_WIDTH, PAGE_HEIGHT = 595, 850


def in_margin(y0: str, y1: str, height: str = str(PAGE_HEIGHT)) -> str:
    """In the top or bottom tenth of the page."""
    return f"({y1} <= {height} * 0.1 OR {y0} >= {height} * 0.9)"


def at_side(x0: str, x1: str, width: str = str(PAGE_WIDTH)) -> str:
    """Narrower than 50 and touching the outer 2 % of the page."""
    return f"(({x0} < {width} * 0.02 OR {x1} > {width} * 0.98) AND {x1} - {x0} < 50)"


def near(a: str, b: str, by: str) -> str:
    """Whether the boxes of two rows overlap or lie within `by` of each other."""
    return f"NOT ({a}.x1 + {by} < {b}.x0 OR {a}.x0 - {by} > {b}.x1 OR {a}.y1 + {by} < {b}.y0 OR {a}.y0 - {by} > {b}.y1)"


def relevance(referenced: str) -> str:
    """margin, side, small, solid, kept or plain for a row of images; referenced: SQL of whether text refers to it."""
    area = "(x1 - x0) * (y1 - y0)"
    return (
        f"CASE WHEN {in_margin('y0', 'y1')} THEN 'margin' WHEN {at_side('x0', 'x1')} THEN 'side' WHEN {area} < 3000 THEN 'small' WHEN coalesce(std_mean < 10, FALSE) THEN 'solid'"
        f" WHEN {referenced} OR (x1 - x0 > 100 AND y1 - y0 > 100) THEN 'kept' ELSE 'plain' END"
    )


def numbered(images: str) -> str:
    """Images that aren't of one colour, numbered anew on their page in the order found."""
    return f"SELECT *, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY img_no) AS number FROM ({images}) AS i WHERE NOT coalesce(std_mean < 10, FALSE)"


def unique_images(images: str, least: int = 2, across: bool = True) -> str:
    """Images whose bytes occur fewer than `least` times; a repeated image goes with all its copies, in the whole set or per document.

    Hashes are counted with partial sums and the repeated ones taken out, so the copies of one image never meet in a task.
    """
    key = "md5" if across else "doc_id, md5"
    same = "rm = md5" if across else "rm = md5 AND rd = doc_id"
    often = f"SELECT {key.replace('doc_id', 'doc_id AS rd').replace('md5', 'md5 AS rm')} FROM ({images}) AS i0 WHERE md5 IS NOT NULL GROUP BY {key} HAVING count(*) >= {least}"
    return f"SELECT i.* FROM ({images}) AS i LEFT JOIN ({often}) AS o ON {same} WHERE rm IS NULL"


def references(d: Dialect, source: str) -> str:
    """doc_id, block_idx, ref_type, pattern_no, ref_number: each reference in the text, once for each pattern that names it."""
    found = [d.each(d.all("text", rf"({p}){S}+(\d+)", 2, fold=True), "m", d.record(kind=d.lit(k), no=str(n), num="m")) for n, (p, k) in enumerate(REFERENCES)]
    rows = f"SELECT doc_id, block_idx, {d.rows(*found)} AS r FROM ({source}) AS s WHERE {d.has('text', _HINT, fold=True)}"
    return f"SELECT doc_id, block_idx, r.kind AS ref_type, r.no AS pattern_no, CAST(right(concat('0', r.num), 9) AS INT) AS ref_number FROM ({rows}) AS a"


def mentions_by_word(d: Dialect, source: str) -> str:
    """doc_id, block_idx, word, numbers: the different numbers after each word for a figure, in the order found."""
    found = [d.each(d.all("text", rf"(({p}){S}+\d+)", 1, fold=True), "m", d.record(no=str(n), m="m")) for n, p in enumerate(MENTIONS)]
    rows = f"SELECT doc_id, block_idx, text, {d.rows(*found)} AS r FROM ({source}) AS s WHERE {d.has('text', _HINT, fold=True)}"
    number = f"CAST(right(concat('0', {d.group('r.m', r'([0-9]+)\z')}), 9) AS BIGINT)"
    word = f"lower({d.group('r.m', f'^([^{S[1:-1]}]+)')})"
    named = f"SELECT doc_id, block_idx, {word} AS word, {number} AS number, r.no * 100000 + instr(text, r.m) AS place FROM ({rows}) AS a"
    # by pattern, then by place in the line
    first = f"SELECT doc_id, block_idx, word, number, CAST(min(place) AS BIGINT) * 1000000000 + number AS place FROM ({named}) AS n GROUP BY doc_id, block_idx, word, number"
    text = "CAST(number AS STRING)" if d.spark else "CAST(number AS VARCHAR)"
    return f"SELECT doc_id, block_idx, word, {d.gather(text, 'place', d.lit(' '))} AS numbers FROM ({first}) AS f GROUP BY doc_id, block_idx, word"


def mapped(maps: str) -> str:
    """The last path given to each (doc_id, ref_type, ref_number) of maps (those, path, seq)."""
    return f"SELECT doc_id, ref_type, ref_number, path FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, ref_type, ref_number ORDER BY seq DESC) AS k FROM ({maps}) AS m) AS n WHERE k = 1"


def looked_up(refs: str, maps: str) -> str:
    """References with the path given to them last; null where there is none."""
    return f"SELECT r.doc_id, r.ref_type, r.ref_number, path FROM ({refs}) AS r LEFT JOIN (SELECT doc_id AS md, ref_type AS mt, ref_number AS mn, path FROM ({mapped(maps)}) AS m0) AS m ON md = r.doc_id AND mt = r.ref_type AND mn = r.ref_number"


def assigned(refs: str, images: str) -> str:
    """References of a page matched with its images by rank: sorted different (type, number) against order of extraction."""
    r = f"SELECT doc_id, page_num, ref_type, ref_number, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY ref_type, ref_number) AS k FROM (SELECT DISTINCT doc_id, page_num, ref_type, ref_number FROM ({refs}) AS r0) AS r1"
    i = f"SELECT doc_id AS di, page_num AS pi, path, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY img_no) AS ki FROM ({images}) AS i0"
    return f"SELECT doc_id, page_num, ref_type, ref_number, path FROM ({r}) AS r JOIN ({i}) AS i ON doc_id = di AND page_num = pi AND k = ki"


def next_free(images: str, used: str) -> str:
    """The first image of each page whose path isn't among the used ones (a column path)."""
    free = f"SELECT i.* FROM ({images}) AS i LEFT JOIN (SELECT DISTINCT path AS up FROM ({used}) AS u0) AS u ON path = up WHERE up IS NULL"
    return f"SELECT doc_id, page_num, path FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY img_no) AS k FROM ({free}) AS f) AS g WHERE k = 1"


def image_lines(d: Dialect) -> str:
    """The Markdown of an image at its page's end: blank, link, caption, blank; its number from _imgN in the path, else 1."""
    n = f"coalesce(nullif({d.group('path', r'_img(\d+)[^/]*\z')}, ''), '1')"
    nl = d.newline()
    return f"concat({nl}, '![Figura ', {n}, '](', path, ')', {nl}, '*Figura ', {n}, '*', {nl})"


def with_images(d: Dialect, pages: str, images: str) -> str:
    """Page bodies (doc_id, page_num, body) with their images' lines at the end."""
    lines = f"SELECT doc_id AS li, page_num AS lp, {d.gather(image_lines(d), 'img_no', d.newline())} AS tail FROM ({images}) AS i GROUP BY doc_id, page_num"
    return f"SELECT doc_id, page_num, CASE WHEN tail IS NULL THEN body ELSE concat(body, {d.newline()}, tail) END AS body FROM ({pages}) AS p LEFT JOIN ({lines}) AS l ON doc_id = li AND page_num = lp"


def linked_paths(d: Dialect, x: str) -> str:
    """Paths that Markdown text links to."""
    return d.all(x, r"\]\(([^)]+)\)", 1)


def job_stats(images: str) -> str:
    """Per document: images found, of one colour, duplicates over all documents, left."""
    often = f"SELECT md5 AS rm FROM ({images}) AS i0 WHERE md5 IS NOT NULL GROUP BY md5 HAVING count(*) > 1"
    c = f"SELECT i.*, rm IS NOT NULL AS again, coalesce(std_mean < 10, FALSE) AS solid FROM ({images}) AS i LEFT JOIN ({often}) AS o ON rm = md5"
    return f"SELECT doc_id, count(*) AS found, sum(CASE WHEN solid THEN 1 ELSE 0 END) AS solid, sum(CASE WHEN NOT solid AND again THEN 1 ELSE 0 END) AS duplicates, sum(CASE WHEN NOT solid AND NOT again THEN 1 ELSE 0 END) AS final FROM ({c}) AS c GROUP BY doc_id"


def magic_type(d: Dialect, x: str) -> str:
    """png, jpg or gif by the first bytes, given in upper-case hexadecimal; png where unknown."""
    return f"CASE WHEN {x} LIKE '89504E47%' THEN 'png' WHEN {x} LIKE 'FFD8%' THEN 'jpg' WHEN {x} LIKE '474946%' THEN 'gif' ELSE 'png' END"


def formula_image(bw: str = "bw_share") -> str:
    """Confidence in hundredths that an image (w, h in pixels; box on the page) shows a formula, and 0 outside 30 x 20 to 1600 x 600."""
    terms = [
        "CASE WHEN w * 1.0 / h BETWEEN 0.8 AND 15 THEN 30 ELSE 0 END", f"CASE WHEN abs((x0 + x1) / 2 - {PAGE_WIDTH} / 2.0) < {PAGE_WIDTH} * 0.2 THEN 25 ELSE 0 END",
        f"CASE WHEN {bw} > 0.9 THEN 30 ELSE 0 END", "CASE WHEN w * h BETWEEN 1000 AND 100000 THEN 15 ELSE 0 END",
    ]
    return f"CASE WHEN w BETWEEN 30 AND 1600 AND h BETWEEN 20 AND 600 THEN {' + '.join(terms)} ELSE 0 END"


_PATTERNS = [(re.compile(rf"(?:{p})\s+(\d+)", re.IGNORECASE), k) for p, k in REFERENCES]


def find_references(text: str | None) -> list[tuple[str, int, int, str]]:
    """(kind, number, position, snippet of 50 characters around it) of a text's references, pattern by pattern."""
    text = text or ""
    return [(k, int(m[1]), m.start(), text[max(0, m.start() - 50) : m.end() + 50]) for p, k in _PATTERNS for m in p.finditer(text)]


def injected(text: str, paths: dict[tuple[str, int], str]) -> str:
    """The text with each mapped reference's image after the next full stop or line end behind it."""
    for kind, number, at, _ in sorted(find_references(text), key=lambda r: -r[2]):
        path = paths.get((kind, number))
        if path:
            at += len(f"{kind} {number}")
            end = re.search(r"[.\n]", text[at:])
            at += end.end() if end else 0
            text = f"{text[:at]}\n\n![{kind.capitalize()} {number}]({path})\n{text[at:]}"
    return text


def with_references(df: DataFrame, source: str = "text", out: str = "refs") -> DataFrame:
    """Adds out, the references of a column of texts: ref_type, ref_number, position, snippet."""
    return df.withColumn(out, python_column(df, source, find_references, "array<struct<ref_type: string, ref_number: int, position: int, snippet: string>>"))


def inject(texts: DataFrame, maps: DataFrame) -> DataFrame:
    """texts (doc_id, text) with the images of maps (doc_id, ref_type, ref_number, path) placed behind their references.

    A document's map is gathered, bounded by its references; of several paths for one reference the last by name counts.
    """
    own = maps.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ref_type", "ref_number", "path"))).alias("_maps"))
    both = texts.join(own, "doc_id", "left").withColumn("_both", F.struct("text", "_maps"))
    place = lambda b: injected(b["text"] or "", {(m["ref_type"], m["ref_number"]): m["path"] for m in b["_maps"]}) if b and b["_maps"] else None
    made = python_column(both, "_both", place, "string", "_maps IS NOT NULL")
    return both.withColumn("text", F.coalesce(made, F.col("text"))).drop("_maps", "_both")
