"""Queries of the image, reference, geometry and formula operators over literal fixtures and document lines."""

from __future__ import annotations

from leafwork.functions import headings as H
from leafwork.functions.dialect import Dialect
from leafwork.operators import detection, formulas as M, geometry as G, images as I, integrity as R, known, notation, paragraphs, polish, rebuild, snippets, spans
from leafwork.operators.merging import merge_fragments, merge_zones
from leafwork.plans.frame import over_tables, read
from leafwork.sources.blocks import blocks, fixture, lines


def values(names: str, rows: list[tuple], kinds: str) -> str:
    """Literal rows as SQL; kinds: a type for each column."""
    show = lambda v, k: "NULL" if v is None else ("'" + v + "'" if isinstance(v, str) else str(v))
    body = ", ".join("(" + ", ".join(show(v, k) for v, k in zip(r, kinds.split())) + ")" for r in rows)
    cols = [f"c{i}" for i in range(len(names.split()))]
    cast = ", ".join(f"CAST({c} AS {k}) AS {n}" for c, k, n in zip(cols, kinds.split(), names.split()))
    return f"SELECT {cast} FROM (VALUES {body}) AS v({', '.join(cols)})"


def _times(d: Dialect, source: str, n: int, name: str) -> str:
    """Each row of source n times, numbered from 0."""
    numbers = d.array(*map(str, range(n)))
    return f"SELECT *, {'explode' if d.spark else 'unnest'}({numbers}) AS {name} FROM ({source}) AS t0"


def _images(d: Dialect) -> str:
    """Images laid out over the first pages of the documents: every third document's bytes repeat."""
    text = "VARCHAR(200)" if not d.spark else "STRING"
    own = f"concat('images/doc', CAST(doc_id AS {text}), '_pag1_img', CAST(n AS {text}), '.png')"
    base = f"SELECT doc_id, n, CAST(CASE WHEN n = 0 THEN doc_id % 3 ELSE doc_id * 10 + n END AS {text}) AS md5, (doc_id * 37 + n * 113) % 500 AS x, (doc_id * 53 + n * 71) % 800 AS y FROM ({_times(d, "SELECT doc_id FROM @documents@", 3, "n")}) AS k"
    dbl = d.double
    return (
        f"SELECT doc_id, CAST(1 + n % 2 AS INT) AS page_num, CAST(n AS INT) AS img_no, {own} AS path, md5, {dbl('x')} AS x0, {dbl('y')} AS y0, {dbl('x + 40 + (doc_id * 7) % 200')} AS x1, {dbl('y + 30 + (doc_id * 11) % 220')} AS y1,"
        f" {dbl('(doc_id * 13 + n * 5) % 40')} AS std_mean FROM ({base}) AS g"
    )


def _words(d: Dialect) -> str:
    """Words with boxes: a formula in disorder, two lines, a superscript, and a grid laid over document lines."""
    kinds = f"BIGINT INT INT {'STRING' if d.spark else 'VARCHAR'} DOUBLE DOUBLE DOUBLE DOUBLE DOUBLE"
    rows = [
        (-1, 1, 0, "V1", 30, 100, 45, 115, 12), (-1, 1, 1, "P1", 0, 100, 15, 115, 12), (-1, 1, 2, "/", 50, 100, 55, 115, 12), (-1, 1, 3, ".", 20, 100, 25, 115, 12), (-1, 1, 4, "C1", 60, 100, 75, 115, 12),
        (-2, 1, 0, "a+b", 0, 100, 30, 115, 12), (-2, 1, 1, "c+d", 0, 130, 30, 145, 12), (-3, 1, 0, "x", 0, 100, 8, 115, 12), (-3, 1, 1, "2", 9, 95, 13, 103, 8), (-3, 1, 2, "i", 14, 106, 17, 114, 8),
        (-3, 1, 3, "exem-", 30, 100, 60, 115, 12), (-3, 1, 4, "plo", 62, 100, 80, 115, 12),
    ]
    grid = f"SELECT doc_id, page_num, block_idx AS idx, text, {d.double('(block_idx * 61) % 400')} AS x0, {d.double('(block_idx * 17) % 120')} AS y0, {d.double('(block_idx * 61) % 400 + 50')} AS x1, {d.double('(block_idx * 17) % 120 + 12')} AS y1, CASE WHEN block_idx % 7 = 3 THEN {d.double('8')} ELSE font_size END AS font_size FROM ({blocks(d)}) AS gb WHERE doc_id >= 0"
    return f"{values('doc_id page_num idx text x0 y0 x1 y1 font_size', rows, kinds)} UNION ALL SELECT * FROM ({grid}) AS grid"


def _zones(d: Dialect) -> str:
    return f"SELECT DISTINCT doc_id, page_num, z AS zone, {d.double('z * 100')} AS x0, {d.double('z * 20')} AS y0, {d.double('z * 100 + 180')} AS x1, {d.double('z * 20 + 60')} AS y1 FROM ({_times(d, f"SELECT DISTINCT doc_id, page_num FROM ({_words(d)}) AS zw", 3, "z")}) AS zk"


def _referenced(d: Dialect) -> str:
    """Image rows with whether their page's number is even, standing for a mention in the text."""
    return f"SELECT doc_id, img_no, {I.relevance('doc_id % 2 = 0')} AS verdict, {I.in_margin('y0', 'y1')} AS margin, {I.at_side('x0', 'x1')} AS side, (x1 - x0) * (y1 - y0) AS area FROM ({_images(d)}) AS i"


def _nearby_text(d: Dialect) -> str:
    """Text of the blocks near each image: the box grown by 50 and then compared with a tolerance of 50."""
    b = f"SELECT *, block_idx * 20.0 AS y0, block_idx * 20.0 + 14 AS y1, 50.0 AS x0, 500.0 AS x1 FROM ({blocks(d)}) AS b"
    grown = f"SELECT doc_id, page_num, img_no, x0 - 50 AS x0, y0 - 50 AS y0, x1 + 50 AS x1, y1 + 50 AS y1 FROM ({_images(d)}) AS i"
    j = f"SELECT i.doc_id, i.img_no, b.block_idx, b.text FROM ({grown}) AS i JOIN ({b}) AS b ON i.doc_id = b.doc_id AND i.page_num = b.page_num AND {I.near('i', 'b', '50')}"
    return f"SELECT doc_id, img_no, {d.gather('text', 'block_idx', d.lit(' '))} AS nearby FROM ({j}) AS j GROUP BY doc_id, img_no"


def _page_refs(d: Dialect) -> str:
    """References as found in the fixture, and two made up on each document's first page."""
    kind = "STRING" if d.spark else "VARCHAR"
    made = f"SELECT doc_id, CAST(1 AS INT) AS page_num, CAST(CASE WHEN k = 0 THEN 'figura' ELSE 'tabela' END AS {kind}) AS ref_type, CAST(doc_id % 7 + k AS INT) AS ref_number FROM ({_times(d, "SELECT doc_id FROM @documents@", 2, "k")}) AS q"
    return f"SELECT doc_id, 1 AS page_num, ref_type, ref_number FROM ({I.references(d, blocks(d))}) AS found UNION ALL {made}"


def _markdown_lines(d: Dialect) -> str:
    return f"SELECT doc_id, block_idx, text FROM ({blocks(d)}) AS b"


def _injected(d: Dialect) -> str:
    return I.with_images(d, paragraphs.page_markdown(d, blocks(d)), _images(d))


def _linked(d: Dialect) -> str:
    paths = I.linked_paths(d, "body")
    one = f"explode({paths})" if d.spark else f"unnest({paths})"
    return f"SELECT doc_id, {one} AS path FROM ({_injected(d)}) AS p"


def _features(d: Dialect) -> str:
    f = M.features(d, "text")
    inner = f"SELECT doc_id, block_idx, {', '.join(f'{v} AS {k}' for k, v in f.items())} FROM ({blocks(d)}) AS b"
    s = f"SELECT *, {M.confidence_percent(d)} AS score FROM ({inner}) AS f"
    return f"SELECT *, {M.confidence_class('score')} AS confidence FROM ({s}) AS s"


def per_line(**columns):
    return lambda d: f"SELECT doc_id, block_idx, {', '.join(f'{make(d)} AS {name}' for name, make in columns.items())} FROM ({blocks(d)}) AS b"


def _regions(d: Dialect) -> str:
    """Intervals made from line lengths, united where they touch."""
    src = f"SELECT doc_id AS grp, block_idx * 40 AS s, block_idx * 40 + length(text) AS e, length(text) % 10 AS conf FROM ({blocks(d)}) AS b"
    return M.merged_regions(src)


def _spans(d: Dialect) -> str:
    font = "CASE WHEN block_idx % 3 = 0 THEN 'Arial-BoldItalic' WHEN block_idx % 3 = 1 THEN 'Times-Oblique' ELSE 'Courier' END"
    s = f"SELECT doc_id, block_idx, text, font_size + block_idx % 15 AS size, font_flags AS flags, {font} AS font FROM ({blocks(d)}) AS b"
    return f"SELECT doc_id, block_idx, {H.span_level(d, 'size', 'flags', 'font')} AS level, {H.span_markdown(d, 'text', 'flags', 'font')} AS markdown FROM ({s}) AS s"


def _files(d: Dialect) -> str:
    heads = values("name head", [("a", "89504E470D0A"), ("b", "FFD8FFE0"), ("c", "474946383961"), ("d", "00010203")], "STRING STRING" if d.spark else "VARCHAR VARCHAR")
    return f"SELECT name, {I.magic_type(d, 'head')} AS kind FROM ({heads}) AS h"


def _formula_images(d: Dialect) -> str:
    src = f"SELECT *, CAST(x1 - x0 AS INT) AS w, CAST(y1 - y0 AS INT) AS h, std_mean / 40 AS bw_share FROM ({_images(d)}) AS i"
    return f"SELECT doc_id, img_no, score, score >= 40 AS formula FROM (SELECT *, {M_score()} AS score FROM ({src}) AS s) AS t"


def M_score() -> str:
    return I.formula_image("(1 - bw_share)")


def _raw_lines(d: Dialect) -> str:
    """All lines, blank ones too, as they are."""
    return f"SELECT doc_id, i AS block_idx, raw AS text FROM ({lines(d)} UNION ALL {fixture(d)}) AS r"


def _stripped_lines(d: Dialect) -> str:
    return f"SELECT doc_id, block_idx, {d.strip('text')} AS text FROM ({_raw_lines(d)}) AS w"


def _zone_blocks(d: Dialect) -> str:
    """Blocks with a font and a box: every fifth set in a mathematical font, every third in the middle."""
    font = "CASE WHEN block_idx % 5 = 0 THEN 'CMMI10' ELSE 'Times' END"
    return f"SELECT doc_id, page_num, block_idx, text, {font} AS font, CASE WHEN block_idx % 3 = 0 THEN 200.0 ELSE 50.0 END AS x0, CASE WHEN block_idx % 3 = 0 THEN 420.0 ELSE 560.0 END AS x1 FROM ({blocks(d)}) AS b"


def _zones_found(d: Dialect) -> str:
    return f"SELECT doc_id, block_idx, score, confidence, zone_type, hints FROM ({M.zones(d, _zone_blocks(d), least=400)}) AS z"


def _joined(d: Dialect) -> str:
    return f"SELECT doc_id, grp, {M.joined_fragments(d, 'merged', 'n')} AS formula FROM ({M.line_groups(d, blocks(d))}) AS g"


def _equations(d: Dialect) -> str:
    from leafwork.functions.text import equation_label

    bare, label = equation_label(d, "text")
    s = f"SELECT doc_id, block_idx, {M.text_latex(d, bare)} AS latex, {label} AS label FROM ({blocks(d)}) AS b"
    return f"SELECT doc_id, block_idx, latex, {M.equation_block(d, 'latex', 'label')} AS block FROM ({s}) AS s"


def _maps(d: Dialect) -> str:
    """Each made-up reference mapped twice, the second time to the path that counts."""
    kind = "STRING" if d.spark else "VARCHAR"
    path = f"concat('images/', ref_type, CAST(ref_number AS {kind}), '_', CAST(seq AS {kind}), '.png')"
    return f"SELECT doc_id, ref_type, ref_number, seq, {path} AS path FROM ({_times(d, f'SELECT DISTINCT doc_id, ref_type, ref_number FROM ({_page_refs(d)}) AS p WHERE ref_number % 3 <> 2', 2, 'seq')}) AS m"


def _lookups(d: Dialect) -> str:
    return I.looked_up(f"SELECT DISTINCT doc_id, ref_type, ref_number FROM ({_page_refs(d)}) AS p", _maps(d))


def _shown_images(d: Dialect) -> str:
    return R.image_names(d, f"SELECT doc_id, body AS text FROM ({_injected(d)}) AS p")


SPECS = {
    "symbol_spacing": per_line(spaced=lambda d: snippets.symbol_spacing(d, "text")),
    "sane_output": per_line(kept=lambda d: snippets.sane_output(d, "concat(text, raw)", "raw"), lost=lambda d: snippets.sane_output(d, "substr(text, 1, 2)", "text")),
    "math_content": per_line(holds=lambda d: spans.has_math(d, "text"), needed=lambda d: spans.needs_conversion(d, "text")),
    "formula_fragments": lambda d: detection.rejoined(d, blocks(d)),
    "formula_context": lambda d: known.contexts(d, blocks(d)),
    "formula_known": lambda d: f"SELECT doc_id, block_idx, confidence, label, name, hint, latex FROM ({known.rebuilt(d, blocks(d))}) AS k",
    "formula_text_blocks": lambda d: known.formatted(d, blocks(d)),
    "formula_descriptions": lambda d: known.described(d, blocks(d)),
    "readable_parts": per_line(readable=lambda d: known.readable(d, "text"), label=lambda d: known.label(d, "text")),
    "line_fragments": lambda d: rebuild.line_fragments(d, _stripped_lines(d)),
    "line_group_text": lambda d: rebuild.line_groups(d, blocks(d)),
    "formula_joined": _joined,
    "equation_blocks": _equations,
    "math_zones": _zones_found,
    "figure_mentions": lambda d: I.mentions_by_word(d, blocks(d)),
    "image_lookup": _lookups,
    "markdown_images": _shown_images,
    "orphan_clean": lambda d: R.cleaned(d, _raw_lines(d)),
    "zone_text": lambda d: G.zone_text(d, _words(d), _zones(d)),
    "image_numbering": lambda d: f"SELECT doc_id, page_num, img_no, number FROM ({I.numbered(_images(d))}) AS n",
    "image_dedup": lambda d: f"SELECT doc_id, img_no, path FROM ({I.unique_images(_images(d))}) AS u",
    "image_dedup_per_document": lambda d: f"SELECT doc_id, img_no, path FROM ({I.unique_images(_images(d), across=False)}) AS u",
    "image_relevance": _referenced,
    "image_injection": _injected,
    "linked_images": _linked,
    "image_magic": _files,
    "job_stats": lambda d: I.job_stats(_images(d)),
    "formula_images": _formula_images,
    "figure_refs": lambda d: I.references(d, blocks(d)),
    "assign_images": lambda d: I.assigned(_page_refs(d), _images(d)),
    "next_free_image": lambda d: I.next_free(_images(d), f"SELECT path FROM ({I.assigned(_page_refs(d), _images(d))}) AS used"),
    "orphan_refs": lambda d: R.orphans(d, _markdown_lines(d)),
    "orphan_refs_with_images": lambda d: R.orphans(d, _markdown_lines(d), _images(d)),
    "orphan_clean_lines": lambda d: R.cleaned_lines(d, _markdown_lines(d)),
    "orphan_figures": lambda d: R.has_orphan_figures(d, _markdown_lines(d), 1),
    "line_context": lambda d: R.context(d, _markdown_lines(d)),
    "nearby_text": _nearby_text,
    "words_in_zone": lambda d: G.in_zone(_words(d), _zones(d)),
    "spatial_order": lambda d: f"SELECT doc_id, page_num, idx, place FROM ({G.ordered(d, _words(d))}) AS o",
    "spatial_text": lambda d: G.page_text(d, _words(d)),
    "subscript_markup": lambda d: G.scripts(d, _words(d)),
    "span_markdown": _spans,
    "math_zone_score": lambda d: f"SELECT doc_id, block_idx, score FROM ({M.zones(d, _zone_blocks(d))}) AS z",
    "formula_features": _features,
    "formula_line": per_line(is_line=lambda d: M.is_formula_line(d, "text"), is_expression=lambda d: M.is_math_expression(d, "text"), inline=lambda d: M.inline_formula(d, "text")),
    "fragment_class": per_line(cls=lambda d: M.fragment_class(d, "text")),
    "fragment_groups": lambda d: M.line_groups(d, blocks(d)),
    "merge_predicates": per_line(unbalanced=lambda d: M.unbalanced(d, "text"), open_end=lambda d: M.ends_open(d, "text"), continues=lambda d: M.starts_closing(d, "text")),
    "latex_chars": per_line(latex=lambda d: M.to_latex(d, "text"), needed=lambda d: M.needs_latex(d, "text"), is_latex=lambda d: M.is_latex(d, "text"), wrapped=lambda d: M.wrapped(d, "text")),
    "plain_scripts": per_line(plain=lambda d: M.plain_scripts(d, "text")),
    "region_merge": _regions,
    "model_for_ram": lambda d: f"SELECT doc_id, {M.model_for_memory(d, 'doc_id % 20')} AS model FROM @documents@",
}


def page_lines(spark, sf_dir: str):
    """Words gathered into lines; a sequential pass over each page, which SQL does not express."""
    return G.lines(over_tables(_words)(spark, sf_dir))


def merged_fragments(spark, sf_dir: str):
    """Words of each page merged as formula fragments; a sequential pass over each page."""
    return merge_fragments(over_tables(_words)(spark, sf_dir).drop("font_size"))


def bullet_lines(spark, sf_dir: str):
    """Words gathered into lines, bullets that stand alone with the line after them."""
    return G.lines(over_tables(_words)(spark, sf_dir), bullets=True)


def merged_zones(spark, sf_dir: str):
    """Mathematical zones of each page united; a sequential pass over each page."""
    found = over_tables(lambda d: M.zones(d, _zone_blocks(d), least=400))(spark, sf_dir)
    boxes = found.selectExpr("doc_id", "page_num", "double(x0) AS x0", "double(block_idx * 20) AS y0", "double(x1) AS x1", "double(block_idx * 20 + 14) AS y1", "confidence / 1000D AS confidence", "split(hints, ' ') AS hints")
    return merge_zones(boxes)


def _over_lines(spark, sf_dir: str):
    return over_tables(lambda d: f"SELECT doc_id, block_idx, text FROM ({blocks(d)}) AS b")(spark, sf_dir)


def _over_texts(spark, sf_dir: str):
    return read(spark, f"{sf_dir}/documents.parquet").select("doc_id", "text")


def math_spans(spark, sf_dir: str):
    """A row for each mathematical span of each line."""
    return spans.with_spans(_over_lines(spark, sf_dir)).selectExpr("doc_id", "block_idx", "inline(spans)")


def math_segments(spark, sf_dir: str):
    """Each line's parts, mathematical or not, in order."""
    return spans.with_segments(_over_lines(spark, sf_dir)).selectExpr("doc_id", "block_idx", "posexplode(segments) AS (place, part)").select("doc_id", "block_idx", "place", "part.*")


def surgical_latex(spark, sf_dir: str):
    """Each line with its mathematical spans as LaTeX."""
    return spans.with_latex(_over_lines(spark, sf_dir)).drop("text")


def formulas_found(spark, sf_dir: str):
    """A row for each formula of each line."""
    return detection.with_formulas(_over_lines(spark, sf_dir)).selectExpr("doc_id", "block_idx", "inline(formulas)")


def formulas_formatted(spark, sf_dir: str):
    """Each line with its formulas as LaTeX."""
    return detection.with_formatted(_over_lines(spark, sf_dir)).drop("text")


def latex_texts(spark, sf_dir: str):
    """Each line as LaTeX."""
    return notation.texts_to_latex(_over_lines(spark, sf_dir)).drop("text")


def formulas_rebuilt(spark, sf_dir: str):
    """Each document with formulas that were broken over lines put together."""
    return rebuild.with_rebuilt(_over_texts(spark, sf_dir)).drop("text")


def math_polished(spark, sf_dir: str):
    """Each document after the phases of the mathematical post-processor."""
    return polish.with_polished(_over_texts(spark, sf_dir)).drop("text")


def technical_fixes(spark, sf_dir: str):
    """Each document with technical names, units and known remains set right."""
    return polish.with_brazilian(_over_texts(spark, sf_dir)).drop("text")


def formula_snippets(spark, sf_dir: str):
    """A row for each snippet that a converter outside would be asked about."""
    return snippets.with_snippets(_over_lines(spark, sf_dir)).selectExpr("doc_id", "block_idx", "inline(snippets)")


def formula_regions(spark, sf_dir: str):
    """A row for each region of each line that reads as a formula."""
    return snippets.with_regions(_over_lines(spark, sf_dir)).selectExpr("doc_id", "block_idx", "inline(regions)")


def offline_conversion(spark, sf_dir: str):
    """The snippets as answered without a converter."""
    return snippets.convert(formula_snippets(spark, sf_dir).selectExpr("doc_id", "block_idx", "start", "snippet AS text"))


def reference_places(spark, sf_dir: str):
    """A row for each reference to a figure in each line, with its place and what surrounds it."""
    return I.with_references(_over_lines(spark, sf_dir)).selectExpr("doc_id", "block_idx", "inline(refs)")


def images_in_text(spark, sf_dir: str):
    """Lines with the images that their references are mapped to."""
    maps = over_tables(lambda d: I.mapped(_maps(d)))(spark, sf_dir)
    return I.inject(_over_lines(spark, sf_dir), maps)


#: Queries without an oracle, over matches' places or passes that SQL does not express: their goldens are in the tests.
EXTRA = {
    f.__name__: f
    for f in (
        page_lines, merged_fragments, bullet_lines, merged_zones, math_spans, math_segments, surgical_latex, formulas_found, formulas_formatted, latex_texts, formulas_rebuilt, math_polished, technical_fixes,
        formula_snippets, formula_regions, offline_conversion, reference_places, images_in_text,
    )
}
