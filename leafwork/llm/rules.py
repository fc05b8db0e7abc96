"""Quality by a sparse rule ensemble: tree paths over text statistics as rules, lasso logistic weights, Spark columns.

Shallow boosted trees over the statistics of a bounded labelled sample give conjunctive rules; logistic regression
with an L1 penalty keeps a few of them; the kept rules become one Spark column expression, so scoring stays in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from leafwork.llm.labelled import HELD_OUT, sample

# Statistics of a text as SQL over t (text, never null), n (code points, at least 1), w (words) and nw (their number, at least 1).
STATISTICS = {
    "log_words": "ln(nw)",
    "word_length": "n / nw",
    "distinct": "size(array_distinct(w)) / nw",
    "symbols": "regexp_count(t, '[^\\\\p{L}\\\\p{N}\\\\s.,]+') / nw",
    "long_symbols": "regexp_count(t, '[^\\\\p{L}\\\\p{N}\\\\s]{2,}') / nw",
    "pipes": "(length(t) - length(replace(t, '|', ''))) / nw",
    "capitals": "regexp_count(t, '\\\\p{Lu}{2,}') / nw",
    "digits": "regexp_count(t, '\\\\p{N}+') / nw",
    "lines": "(length(t) - length(replace(t, '\\n', ''))) / nw",
    "stops": "(length(t) - length(replace(t, '.', ''))) / nw",
    "commas": "(length(t) - length(replace(t, ',', ''))) / nw",
}


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the statistics of a column to docs, as _s_ and their name; a null text counts as empty.

    Columns _t, _w, _n and _nw are used on the way and must not be there.
    """
    base = docs.withColumn("_t", F.coalesce(text, F.lit("")))
    base = base.withColumn("_w", F.expr("filter(split(_t, '[\\\\x20\\\\x09-\\\\x0D]+'), x -> x <> '')"))
    base = base.withColumn("_n", F.expr("greatest(1, length(_t))")).withColumn("_nw", F.expr("greatest(1, size(_w))"))
    import re

    named = {f"_s_{k}": F.expr(re.sub(r"\b(t|n|w|nw)\b(?!')", r"_\1", v.replace("\\\\", "\x01")).replace("\x01", "\\\\")).cast("double") for k, v in STATISTICS.items()}
    return base.withColumns(named).drop("_t", "_w", "_n", "_nw")


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is below or at, bound)."""

    terms: tuple[tuple[str, bool, float], ...]

    def sql(self) -> str:
        return " AND ".join(f"_s_{s} {'<=' if low else '>'} {bound!r}D" for s, low, bound in self.terms)

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for s, low, bound in self.terms:
            out &= (x[s] <= bound) if low else (x[s] > bound)
        return out


def tree_rules(x: dict[str, np.ndarray], y: np.ndarray, trees: int = 24, depth: int = 3, bins: int = 32, least: int = 20, seed: int = 5) -> list[Rule]:
    """The paths of boosted regression trees on the logistic loss, each tree on half of the rows."""
    names = list(x)
    cuts = {s: np.unique(np.quantile(x[s], np.linspace(0, 1, bins + 1)[1:-1])) for s in names}
    code = {s: np.searchsorted(cuts[s], x[s], side="left") for s in names}  # code <= k means x <= cuts[k]
    rng, score, found = np.random.default_rng(seed), np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        chosen = rng.random(len(y)) < 0.5
        leaves = [((), np.ones(len(y), bool))]
        for _ in range(depth):
            grown = []
            for path, rows in leaves:
                own, best = rows & chosen, (1e-6, None)
                if own.sum() >= 2 * least:
                    for s in names:
                        m = len(cuts[s]) + 1
                        g, h, c = (np.cumsum(np.bincount(code[s][own], v, m)) for v in (grad[own], hess[own], np.ones(own.sum())))
                        ok = (c[:-1] >= least) & (c[-1] - c[:-1] >= least)
                        gain = np.where(ok, g[:-1] ** 2 / (h[:-1] + 1) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + 1) - g[-1] ** 2 / (h[-1] + 1), 0) if m > 1 else np.zeros(0)
                        if len(gain) and gain.max() > best[0]:
                            best = (gain.max(), (s, int(gain.argmax())))
                if best[1] is None:
                    grown.append((path, rows))
                    continue
                s, k = best[1]
                low = code[s] <= k
                for side, mask in ((True, low), (False, ~low)):
                    longer = (*path, (s, side, float(cuts[s][k])))
                    found.setdefault(frozenset(longer), Rule(longer))
                    grown.append((longer, rows & mask))
            leaves = grown
        for _, rows in leaves:
            own = rows & chosen
            score[rows] += 0.3 * grad[own].sum() / (hess[own].sum() + 1)
    return list(found.values())


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 800) -> tuple[float, np.ndarray]:
    """Intercept and L1-penalised weights by accelerated proximal gradient."""
    n = len(y)
    rate = 4 * n / (np.linalg.norm(np.column_stack([a, np.ones(n)]), 2) ** 2)
    w, b, v, c, t = np.zeros(a.shape[1]), 0.0, np.zeros(a.shape[1]), 0.0, 1.0
    for _ in range(steps):
        r = (1 / (1 + np.exp(-(a @ v + c))) - y) / n
        w2 = v - rate * (a.T @ r)
        w2 = np.sign(w2) * np.maximum(0, np.abs(w2) - rate * penalty)
        b2 = c - rate * r.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return float(b), w


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def sql(self) -> str:
        """The score, 0 to 1, as SQL over the statistics."""
        terms = " + ".join([repr(self.intercept) + "D", *(f"IF({r.sql()}, {w!r}D, 0D)" for r, w in self.rules)])
        return f"1D / (1D + exp(-({terms})))"


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = 8000, penalty: float = 5e-4) -> RuleModel:
    """Fits the ensemble to at most `rows` labelled documents that aren't held out; their statistics alone come to the driver."""
    got = statistics(sample(docs, labels, label, rows)).select("y", *(f"_s_{s}" for s in STATISTICS)).toPandas()
    y = got["y"].to_numpy(float)
    if len(y) == 0 or y.min() == y.max():  # nothing to learn from: the prior alone
        p = (y.sum() + 1) / (len(y) + 2)
        return RuleModel(float(np.log(p / (1 - p))), ())
    got = got.iloc[np.lexsort(got.to_numpy().T)]
    y = got["y"].to_numpy(float)
    x = {s: got[f"_s_{s}"].to_numpy(float) for s in STATISTICS}
    rules = tree_rules(x, y)
    holds = np.column_stack([r.holds(x) for r in rules]).astype(float)
    _, first = np.unique(holds, axis=1, return_index=True)  # rules that hold for the same rows count once
    first = np.sort(first)
    b, w = lasso_logistic(holds[:, first], y, penalty)
    return RuleModel(b, tuple((rules[k], float(v)) for k, v in zip(first, w) if abs(v) > 1e-3))


def score(docs: DataFrame, model: RuleModel) -> DataFrame:
    """Adds held_out and score to docs (doc_id, text); empty and null texts get the score of their statistics.

    Rows that repeat are scored alike, a null doc_id counts as an empty one in held_out, an empty table stays empty.
    Columns held_out and score in docs are replaced, all others stay, whatever their names.
    """
    own = docs.drop("score", "held_out")
    packed = own.select(F.struct("*").alias("row"), F.col("text"), F.expr(HELD_OUT).alias("held_out"))
    return statistics(packed).withColumn("score", F.expr(model.sql())).select("row.*", "score", "held_out")
