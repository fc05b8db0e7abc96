"""From blocks to Markdown: repeated lines, paragraphs, lists and headings, pages, documents.

The order within a page is a running state in the source's terms; here it is windows over (doc_id, page_num): whether a
line continues a list is the running maximum of "is an item" since the last line that is neither item nor continuation,
and paragraphs are islands of a running sum of starts. All windows share one distribution by document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from leafwork.functions import lists, text as T
from leafwork.functions.dialect import Dialect, S
from leafwork.functions.headings import word_count
from leafwork.plans.frame import apply

_PAGE = "PARTITION BY doc_id, page_num ORDER BY block_idx"


def without_repeats(d: Dialect, blocks: str, scope: str = "document") -> str:
    """Blocks without page furniture and without texts on max(3, 30 %) of the document's pages or more.

    Pages are counted by ranks in windows over the document, so the blocks are read once and dealt out once.

    scope "page" judges each page alone, as the service does: no text then repeats often enough.
    """
    keyed = d.once(blocks, repeat_key=T.repeat_key(d, "text"))
    if scope == "page":
        return f"SELECT * FROM ({keyed}) AS k WHERE NOT {T.is_page_furniture(d, 'text')}"
    ranked = f"SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY page_num) AS page_rank, dense_rank() OVER (PARTITION BY doc_id, repeat_key ORDER BY page_num) AS key_rank FROM ({keyed}) AS k"
    counted = f"SELECT *, max(page_rank) OVER (PARTITION BY doc_id) AS pages, max(key_rank) OVER (PARTITION BY doc_id, repeat_key) AS key_pages FROM ({ranked}) AS r"
    return f"SELECT * FROM ({counted}) AS c WHERE key_pages < greatest(3, pages * 0.3) AND NOT {T.is_page_furniture(d, 'text')}"


def marked(d: Dialect, blocks: str, scope: str = "document") -> str:
    """Cleaned blocks with kind: item, more (of an item), heading, bold or plain, and brk: a plain one that starts anew."""
    clean = d.once(without_repeats(d, blocks, scope), cleaned=T.clean_text(d, "text"))
    t = f"SELECT doc_id, page_num, block_idx, font_size, bold, t FROM ({d.once(clean, t=T.clean_artifacts(d, 'cleaned'))}) AS c"
    t = f"SELECT * FROM ({t}) AS t0 WHERE t <> '' AND NOT {T.is_garbage(d, 't')}"
    flags = d.once(t, item=lists.is_list_item(d, "t"), heading=T.is_heading_candidate(d, "t", "font_size"))
    soft = f"length(t) < 60 AND ({d.is_lower(d.first('t'))} OR {word_count(d, 't')} <= 2 OR {d.last('t')} = ';') AND NOT heading"
    flags = f"SELECT *, NOT item AND {soft} AS soft, lag(font_size) OVER ({_PAGE}) AS size_before, lag(t) OVER ({_PAGE}) AS t_before FROM ({flags}) AS t2"
    runs = f"SELECT *, sum(CASE WHEN item OR soft THEN 0 ELSE 1 END) OVER ({_PAGE}) AS run FROM ({flags}) AS t3"
    listed = f"SELECT *, coalesce(max(CASE WHEN item THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_num, run ORDER BY block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS listed FROM ({runs}) AS t4"
    kind = f"SELECT *, CASE WHEN item THEN 'item' WHEN soft AND listed = 1 THEN 'more' WHEN heading THEN 'heading' WHEN bold AND length(t) < 100 THEN 'bold' ELSE 'plain' END AS kind FROM ({listed}) AS t5"
    before = f"SELECT *, lag(kind) OVER ({_PAGE}) AS kind_before FROM ({kind}) AS t6"
    jump = f"coalesce(abs(font_size - size_before) > 2, FALSE) OR (kind_before = 'plain' AND {d.last('t_before')} = '.' AND {d.is_upper(d.first('t'))}) OR {d.has('t', rf'^[\d\-•]{S}')}"
    return f"SELECT *, coalesce(kind = 'plain' AND ({jump}), FALSE) AS brk FROM ({before}) AS t7"


def units(d: Dialect, blocks: str, scope: str = "document") -> str:
    """doc_id, page_num, unit, kind (item, heading, text), body: a row for each list item, heading and paragraph."""
    start = "CASE WHEN kind IN ('item', 'heading') OR kind_before IS NULL OR (kind IN ('bold', 'plain') AND (kind_before NOT IN ('bold', 'plain') OR brk)) THEN 1 ELSE 0 END"
    numbered = f"SELECT *, sum({start}) OVER ({_PAGE}) AS unit FROM ({marked(d, blocks, scope)}) AS m"
    k, m, c = lists.list_parts(d, "t")
    typed = d.once(numbered, lk=k, lm=m, lc=c, level=T.heading_level(d, "t", "font_size"))
    part = (
        f"CASE kind WHEN 'item' THEN {lists.list_markdown(d, 't', 'lk', 'lm', 'lc')} WHEN 'heading' THEN CASE WHEN level > 0 THEN concat(repeat('#', level), ' ', t) ELSE concat('**', t, '**') END"
        " WHEN 'bold' THEN concat('**', t, '**') ELSE t END"
    )
    parts = f"SELECT doc_id, page_num, unit, block_idx, kind, {part} AS part FROM ({typed}) AS y"
    # the first row of a unit tells its kind; item < heading < text by the names below
    tag = "min(CASE WHEN kind = 'item' THEN 'item' WHEN kind = 'heading' THEN 'heading' ELSE 'text' END)"
    sep = d.lit(" ")
    return f"SELECT doc_id, page_num, unit, CASE WHEN max(CASE WHEN kind = 'item' THEN 1 ELSE 0 END) = 1 THEN 'item' ELSE {tag} END AS kind, {d.gather('part', 'block_idx', sep)} AS body FROM ({parts}) AS z GROUP BY doc_id, page_num, unit"


def page_markdown(d: Dialect, blocks: str, scope: str = "document") -> str:
    """doc_id, page_num, body: the page's Markdown lines; a blank line ends a list, a list within a line becomes one."""
    k, m, c = lists.list_parts(d, "body")
    intro, items = lists.inline_parts(d, "body")
    listed = d.once(units(d, blocks, scope), has_list=lists.has_inline_list(d, "body"))
    parts = d.once(listed, intro=f"CASE WHEN has_list THEN {intro} ELSE body END", items=f"CASE WHEN has_list THEN {items} END", lk=k, lm=m, lc=c)
    split = f"SELECT *, lead(kind) OVER (PARTITION BY doc_id, page_num ORDER BY unit) AS kind_after FROM ({parts}) AS u"
    body = (
        f"CASE WHEN kind = 'item' THEN CASE WHEN coalesce(kind_after, '') = 'item' THEN body ELSE concat(body, {d.newline()}) END"
        f" WHEN kind = 'text' AND has_list THEN CASE WHEN {lists.is_list_item(d, 'body')} THEN {lists.list_markdown(d, 'body', 'lk', 'lm', 'lc')} ELSE {lists.inline_markdown(d, 'body', 'intro', 'items', 'has_list')} END ELSE body END"
    )
    lined = f"SELECT doc_id, page_num, unit, {body} AS line FROM ({split}) AS s"
    return f"SELECT doc_id, page_num, {d.gather('line', 'unit', d.newline())} AS body FROM ({lined}) AS l GROUP BY doc_id, page_num"


def document_markdown(d: Dialect, blocks: str, scope: str = "document", title: str | None = None) -> str:
    """doc_id, markdown: pages in order between --- lines, at most one blank line in a row; title: SQL of a first heading."""
    nl = d.newline()
    rule = f"concat({nl}, {nl}, '---', {nl}, {nl})"
    joined = f"SELECT doc_id, {d.gather('body', 'page_num', rule)} AS body FROM ({page_markdown(d, blocks, scope)}) AS p GROUP BY doc_id"
    whole = "body" if title is None else f"concat('# ', {title}, {nl}, {nl}, body)"
    return f"SELECT doc_id, {T.markdown_spacing(d, whole)} AS markdown FROM ({joined}) AS j"


def consolidate(blocks: DataFrame, scope: str = "document") -> DataFrame:
    """units() of a DataFrame of blocks (doc_id, page_num, block_idx, text, font_size, bold); the input's order is of no matter."""
    return apply(lambda d: units(d, "SELECT * FROM @blocks@", scope), blocks=blocks.repartition("doc_id"))


def to_markdown(blocks: DataFrame, scope: str = "document") -> DataFrame:
    """document_markdown() of a DataFrame of blocks; one exchange by doc_id serves all windows."""
    return apply(lambda d: document_markdown(d, "SELECT * FROM @blocks@", scope), blocks=blocks.repartition("doc_id"))
