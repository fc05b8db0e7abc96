"""Sequential folds over the fragments of a page: formula fragments, mathematical zones, reconstructed lines.

Whether a fragment joins depends on the text or box gathered so far, so a page is one pass (applyInPandas by document
and page); pages are bounded, documents and the corpus are not.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame

from leafwork.operators.formulas import END_OPERATORS, START_OPERATORS
from leafwork.session import ship

#: What each reason to merge is worth.
WEIGHTS = {"brace_balance": 0.95, "syntactic_bridge": 0.85, "vertical_proximity": 0.70, "none": 0.80}
_BEGIN, _END = re.compile(r"\\begin\{[^}]+\}"), re.compile(r"\\end\{[^}]+\}")


def open_ended(text: str) -> bool:
    """Unequal opening and closing marks, \\left and \\right, \\begin and \\end."""
    pairs = [(sum(map(text.count, "([{")), sum(map(text.count, ")]}"))), (text.count("\\left"), text.count("\\right")), (len(_BEGIN.findall(text)), len(_END.findall(text)))]
    return any(a != b for a, b in pairs)


def merge_reason(text: str, y0: float, y1: float, nxt: str, ny0: float, gap: float = 15.0, same: float = 5.0) -> str | None:
    """Why the next fragment joins what is gathered; None where it doesn't."""
    text, nxt = text.strip(), nxt.strip()
    if not text or not nxt:
        return None
    space = ny0 - y1
    if open_ended(text) and space < 2 * gap or len(_BEGIN.findall(text)) > len(_END.findall(text)):
        return "brace_balance"
    if space < gap:
        if text[-1] in END_OPERATORS or text.endswith(("\\left", "\\left(")) or nxt[0] in START_OPERATORS:
            return "syntactic_bridge"
        if abs(y0 - ny0) < same:
            return "vertical_proximity"
    return None


def merge_fragments(fragments: DataFrame, gap: float = 15.0, most: int = 20) -> DataFrame:
    """doc_id, page_num, formula_no, text, n, confidence, box of fragments (doc_id, page_num, idx, text, x0, y0, x1, y1).

    Fragments are read by (y0, x0); texts on one line are joined by a space, others too. At most `most` join.
    """
    ship(fragments.sparkSession)

    def page(df: pd.DataFrame) -> pd.DataFrame:
        out, held = [], None
        for f in df.sort_values(["y0", "x0", "idx"], kind="stable").itertuples():
            why = merge_reason(held["text"], held["y0"], held["y1"], f.text, f.y0, gap) if held and held["n"] < most else None
            if why:
                held["text"] = f"{held['text'].strip()} {f.text.strip()}"
                held["n"] += 1
                held["why"].append(WEIGHTS[why])
                held |= {"x0": min(held["x0"], f.x0), "y0": min(held["y0"], f.y0), "x1": max(held["x1"], f.x1), "y1": max(held["y1"], f.y1)}
            else:
                if held:
                    out.append(held)
                held = {"text": f.text, "n": 1, "why": [], "x0": f.x0, "y0": f.y0, "x1": f.x1, "y1": f.y1}
        if held:
            out.append(held)
        rows = [(df["doc_id"].iloc[0], df["page_num"].iloc[0], k, h["text"].strip(), h["n"], sum(h["why"]) / len(h["why"]) if h["why"] else 1.0, h["x0"], h["y0"], h["x1"], h["y1"]) for k, h in enumerate(out)]
        return pd.DataFrame(rows, columns=["doc_id", "page_num", "formula_no", "text", "n", "confidence", "x0", "y0", "x1", "y1"])

    kind = "doc_id long, page_num int, formula_no int, text string, n int, confidence double, x0 double, y0 double, x1 double, y1 double"
    return fragments.groupBy("doc_id", "page_num").applyInPandas(page, kind)


def merge_zones(zones: DataFrame, gap: float = 20.0) -> DataFrame:
    """Zones (doc_id, page_num, x0, y0, x1, y1, confidence, hints) of a page united, top to bottom, while they follow within `gap` and overlap sideways."""
    ship(zones.sparkSession)

    def page(df: pd.DataFrame) -> pd.DataFrame:
        out: list[dict] = []
        for z in df.sort_values(["y0", "x0"], kind="stable").to_dict("records"):
            z["hints"] = list(z["hints"])
            if out and z["y0"] - out[-1]["y1"] <= gap and min(z["x1"], out[-1]["x1"]) - max(z["x0"], out[-1]["x0"]) > -gap:
                o = out[-1]
                o |= {"x0": min(o["x0"], z["x0"]), "y0": min(o["y0"], z["y0"]), "x1": max(o["x1"], z["x1"]), "y1": max(o["y1"], z["y1"]), "confidence": max(o["confidence"], z["confidence"])}
                o["hints"] = sorted({*o["hints"], *z["hints"]})
            else:
                out.append(z)
        return pd.DataFrame(out)[["doc_id", "page_num", "x0", "y0", "x1", "y1", "confidence", "hints"]]

    return zones.groupBy("doc_id", "page_num").applyInPandas(page, "doc_id long, page_num int, x0 double, y0 double, x1 double, y1 double, confidence double, hints array<string>")
