"""Words on a page: reading order, zones, lines, sub- and superscripts.

words: doc_id, page_num, idx, text, x0, y0, x1, y1, font_size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from leafwork.functions.dialect import Dialect, S, W
from leafwork.session import ship

_PAGE = "PARTITION BY doc_id, page_num"


def ordered(d: Dialect, words: str, tolerance: float = 3.0) -> str:
    """Words with place, their rank by rows of `tolerance` height (half to even) and x."""
    row = d.half_even(f"y0 / {d.double(str(tolerance))}")
    return f"SELECT *, row_number() OVER ({_PAGE} ORDER BY {row}, x0, idx) AS place FROM ({words}) AS w WHERE text <> ''"


def page_text(d: Dialect, words: str, tolerance: float = 3.0) -> str:
    """doc_id, page_num, line: the words in order, single spaces, words split by a hyphen joined."""
    sep = d.lit(" ")
    joined = f"SELECT doc_id, page_num, {d.gather('text', 'place', sep)} AS line FROM ({ordered(d, words, tolerance)}) AS o GROUP BY doc_id, page_num"
    return f"SELECT doc_id, page_num, {d.strip(d.sub(d.sub('line', f'{S}+', ' '), rf'({W})-{S}+({W})', r'\1\2'))} AS line FROM ({joined}) AS j"


def scripts(d: Dialect, words: str, tolerance: float = 3.0) -> str:
    """doc_id, page_num, line with small words marked _{} where they stand lower than the word before, ^{} where higher."""
    o = f"SELECT *, avg(font_size) OVER ({_PAGE}) AS mean, lag(y0) OVER ({_PAGE} ORDER BY place) AS above FROM ({ordered(d, words, tolerance)}) AS o"
    mark = "CASE WHEN font_size < mean * 0.8 AND y0 - above > mean * 0.2 THEN concat('_{', text, '}') WHEN font_size < mean * 0.8 AND y0 - above < -mean * 0.2 THEN concat('^{', text, '}') ELSE text END"
    sep = d.lit(" ")
    return f"SELECT doc_id, page_num, {d.gather('part', 'place', sep)} AS line FROM (SELECT doc_id, page_num, place, {mark} AS part FROM ({o}) AS m) AS p GROUP BY doc_id, page_num"


def in_zone(words: str, zones: str) -> str:
    """Words whose centre lies in a zone (doc_id, page_num, zone, x0, y0, x1, y1), edges included; an equality join on the page."""
    cx, cy = "(w.x0 + w.x1) / 2", "(w.y0 + w.y1) / 2"
    return f"SELECT w.doc_id, w.page_num, zone, idx, text FROM ({words}) AS w JOIN ({zones}) AS z ON w.doc_id = z.doc_id AND w.page_num = z.page_num AND {cx} BETWEEN z.x0 AND z.x1 AND {cy} BETWEEN z.y0 AND z.y1"


#: Bullets and boxes that stand alone where a page's lines drift apart.
BULLETS = "\uf0fc\uf0b7\uf0a7\uf076\uf077\uf0fe•◦○●■□▪▫‣⁃✓✗✔✘☐☑☒-–—−*"


def lines(words: DataFrame, tolerance: float = 5.0, bullets: bool = False) -> DataFrame:
    """doc_id, page_num, line_no, text, x0, y0, x1, y1: words gathered into lines.

    In order of (y0, x0) a word joins the line when it overlaps the line's height within `tolerance`, or starts within
    twice that of its top; the line's height grows as words join, so a page is one sequential pass. With `bullets`, a
    line that is one bullet and starts within three times the tolerance of the next line's top becomes a part of it.
    """
    ship(words.sparkSession)

    def page(df: pd.DataFrame) -> pd.DataFrame:
        df = df[df["text"].str.strip() != ""].sort_values(["y0", "x0", "idx"], kind="stable")
        line, top, low, n = [], np.inf, -np.inf, -1
        for y0, y1 in zip(df["y0"], df["y1"]):
            if n >= 0 and ((y0 <= low + tolerance and y1 >= top - tolerance) or abs(y0 - top) <= 2 * tolerance):
                top, low = min(top, y0), max(low, y1)
            else:
                n, top, low = n + 1, y0, y1
            line.append(n)
        df = df.assign(line_no=line)
        if bullets and len(df):
            tops, held = df.groupby("line_no")["y0"].min(), df.groupby("line_no")["text"].agg(list)
            alone = [len(t) == 1 and len(t[0].strip()) <= 2 and any(c in BULLETS for c in t[0]) for t in held]
            into, k, new = [], 0, 0
            while k < len(held):
                n = 2 if alone[k] and k + 1 < len(held) and abs(tops[k + 1] - tops[k]) <= 3 * tolerance else 1
                into += [new] * n
                k, new = k + n, new + 1
            df["line_no"] = df["line_no"].map(dict(enumerate(into)))
        df = df.sort_values(["line_no", "x0", "idx"], kind="stable")
        out = df.groupby("line_no").agg(text=("text", " ".join), x0=("x0", "min"), y0=("y0", "min"), x1=("x1", "max"), y1=("y1", "max")).reset_index()
        out.insert(0, "page_num", df["page_num"].iloc[0] if len(df) else 0)
        out.insert(0, "doc_id", df["doc_id"].iloc[0] if len(df) else 0)
        return out

    return words.groupBy("doc_id", "page_num").applyInPandas(page, "doc_id long, page_num int, line_no long, text string, x0 double, y0 double, x1 double, y1 double")


def zone_text(d: Dialect, words: str, zones: str, tolerance: float = 3.0) -> str:
    """doc_id, page_num, zone, line: the words whose centre lies in each zone, in reading order, hyphens joined."""
    inside = f"SELECT z.doc_id, z.page_num, z.zone, w.idx, w.text, w.x0, w.y0 FROM ({words}) AS w JOIN ({zones}) AS z ON w.doc_id = z.doc_id AND w.page_num = z.page_num AND (w.x0 + w.x1) / 2 BETWEEN z.x0 AND z.x1 AND (w.y0 + w.y1) / 2 BETWEEN z.y0 AND z.y1 WHERE w.text <> ''"
    row = d.half_even(f"y0 / {d.double(str(tolerance))}")
    placed = f"SELECT *, row_number() OVER (PARTITION BY doc_id, page_num, zone ORDER BY {row}, x0, idx) AS place FROM ({inside}) AS i"
    joined = f"SELECT doc_id, page_num, zone, {d.gather('text', 'place', d.lit(' '))} AS line FROM ({placed}) AS p GROUP BY doc_id, page_num, zone"
    return f"SELECT doc_id, page_num, zone, {d.strip(d.sub(d.sub('line', f'{S}+', ' '), rf'({W})-{S}+({W})', r'\1\2'))} AS line FROM ({joined}) AS j"
