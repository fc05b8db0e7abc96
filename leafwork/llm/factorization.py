"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(b + sum w[i] + sum over pairs i < j of <v[i], v[j]>) over the distinct terms i of a text: pairs such as
an insult with a group mention count beyond their parts. Fitted by AdaGrad on a bounded labelled sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from leafwork.llm.common import small_batches
from leafwork.llm.labelled import HELD_OUT, sample
from leafwork.llm.textbytes import U, buffers, chunks, give_back, tidy, words

BITS = 18


def terms(raw: np.ndarray, offsets: np.ndarray, bits: int = BITS, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each row's distinct lower-cased words, punctuation at their ends left off; keep: buckets of use."""
    clean = EDGE[raw]
    hashes, _, _, at = words(clean, offsets)
    bucket = (hashes >> U(64 - bits)).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    if keep is not None:
        use = keep[bucket]
        bucket, row = bucket[use], row[use]
    both = np.unique(row << bits | bucket)
    return both >> bits, both & ((1 << bits) - 1)


#: ASCII punctuation counts as a space here, so that a word is found beside a comma, a quote or in brackets.
EDGE = np.arange(256, dtype=np.uint8)
EDGE[[c for c in range(33, 127) if not chr(c).isalnum()]] = 0x20


@dataclass
class Machine:
    bits: int
    b: float
    bucket: np.ndarray  # the buckets with weights, ascending
    w: np.ndarray
    v: np.ndarray  # a row of factors for each

    def scores(self, row: np.ndarray, k: np.ndarray, rows: int) -> np.ndarray:
        """k: positions in bucket."""
        out = self.b + np.bincount(row, self.w[k], rows)
        for f in range(self.v.shape[1]):
            own = self.v[k, f]
            out += 0.5 * (np.bincount(row, own, rows) ** 2 - np.bincount(row, own * own, rows))
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = 8_000, factors: int = 4, epochs: int = 6, least: int = 5, bits: int = BITS, seed: int = 3) -> Machine:
    """Fits to at most `rows` labelled documents that aren't held out; their hashed terms alone come to the driver.

    Buckets in fewer than `least` sampled documents have no weight.
    """
    small_batches(docs.sparkSession)

    def hashed(batches):
        for batch in batches:
            raw, offsets = buffers(batch.column("text"))
            for a, b in chunks(offsets):
                row, bucket = terms(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], bits)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(b - a + 1)), pa.int32()), pa.array(bucket, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a).cast(pa.int64()), batch.column("y").slice(a, b - a), lists], ["doc_id", "y", "terms"])

    got = sample(docs, labels, label, rows).mapInArrow(tidy(hashed), "doc_id long, y double, terms array<int>").toArrow()  # at most `rows`
    got = got.sort_by([("doc_id", "ascending"), ("y", "ascending")]).combine_chunks()
    y = got.column("y").to_numpy()
    n = len(y)
    prior = (y.sum() + 0.1) / (n + 1)  # 0.1 where nothing is labelled
    b = float(np.log(prior / (1 - prior)))
    none = Machine(bits, b, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, factors)))
    if n == 0 or y.min() == y.max():
        return none
    size = pc.list_value_length(got.column("terms")).to_numpy()
    flat = pc.list_flatten(got.column("terms")).to_numpy()
    del got
    row = np.repeat(np.arange(n, dtype=np.int32), size)
    used = np.zeros(1 << bits, np.int32)
    for s in range(0, len(flat), 1 << 20):
        used += np.bincount(flat[s : s + (1 << 20)], minlength=1 << bits).astype(np.int32)
    bucket = np.flatnonzero(used >= least)
    if not len(bucket):
        return none
    place = np.full(1 << bits, -1, np.int32)
    place[bucket] = np.arange(len(bucket))
    k = place[flat]
    del flat
    keep = k >= 0
    k, row = k[keep], row[keep]
    at = np.searchsorted(row, np.arange(n + 1))
    del keep, row
    b, w, v = descend(k, at, y, len(bucket), b, factors, epochs, seed)
    del k, at, y
    give_back()  # the driver goes on with other stages
    return Machine(bits, b, bucket, w, v)


def descend(k: np.ndarray, at: np.ndarray, y: np.ndarray, size: int, b: float, factors: int, epochs: int, seed: int, l1: float = 1e-3) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors by AdaGrad on the logistic loss; row i has the terms k[at[i] : at[i + 1]] of `size`.

    The L1 step keeps terms without evidence at zero.
    """
    rng = np.random.default_rng(seed)
    n = len(y)
    # start from half the log odds of the terms whose share among the positive differs by over 4 deviations
    pos, all_ = np.zeros(size), np.zeros(size)
    for s in range(0, n, 1024):
        e = min(n, s + 1024)
        own = k[at[s] : at[e]]
        pos += np.bincount(own, np.repeat(y[s:e], np.diff(at[s : e + 1])), size)
        all_ += np.bincount(own, minlength=size)
    share = y.sum() / n
    far = np.abs(pos - all_ * share) / np.sqrt(all_ * share * (1 - share) + 1e-9) > 4
    odds = np.log((pos + 0.5) / (y.sum() + 1)) - np.log((all_ - pos + 0.5) / (n - y.sum() + 1))
    w, v = np.where(far, odds / 2, 0.0), rng.normal(0, 0.01, (size, factors))
    gw, gv, gb = np.full(size, 1.0), np.full(v.shape, 1.0), 1.0
    for _ in range(epochs):
        order = rng.permutation(n)
        for s in range(0, n, 256):
            own = order[s : s + 256]
            count = at[own + 1] - at[own]
            kk = k[np.arange(count.sum()) + np.repeat(at[own] - (np.cumsum(count) - count), count)]
            rr = np.repeat(np.arange(len(own)), count)
            total = np.stack([np.bincount(rr, v[kk, f], len(own)) for f in range(factors)], 1)
            square = np.bincount(rr, (v[kk] ** 2).sum(1), len(own))
            z = b + np.bincount(rr, w[kk], len(own)) + 0.5 * ((total**2).sum(1) - square)
            r = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[own]
            gb += r.sum() ** 2
            b -= 0.2 * r.sum() / np.sqrt(gb)
            g = np.bincount(kk, r[rr], size)
            gw += g * g
            rate = 0.3 / np.sqrt(gw)
            w = w - rate * g
            w = np.sign(w) * np.maximum(0, np.abs(w) - rate * l1 * len(own))
            for f in range(factors):
                g = np.bincount(kk, r[rr] * (total[rr, f] - v[kk, f]), size) + 1e-2 * v[:, f]
                gv[:, f] += g * g
                v[:, f] -= 0.05 * g / np.sqrt(gv[:, f])
            v[w == 0] *= 0.98  # factors of terms without a weight fade
    return float(b), w, v


def score(docs: DataFrame, model: Machine) -> DataFrame:
    """Adds held_out and score (0 to 1) to docs (doc_id, text); a null or empty text has the score of no terms.

    Rows that repeat are scored alike, an empty table stays empty. Columns held_out and score in docs are replaced, all
    others stay, whatever their names.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded: at most 2**bits buckets

    def scored(batches):
        m = held.value
        keep = np.zeros(1 << m.bits, bool)
        keep[m.bucket] = True
        for batch in batches:
            raw, offsets = buffers(batch.column("text"))
            out = [np.zeros(0)]
            for a, b in chunks(offsets):
                row, bucket = terms(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], m.bits, keep)
                out.append(m.scores(row, np.searchsorted(m.bucket, bucket), b - a))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out))], [*batch.schema.names, "score"])

    kind = ", ".join(f"`{n}` {t}" for n, t in docs.drop("score", "held_out").dtypes)
    return docs.drop("score", "held_out").mapInArrow(tidy(scored), f"{kind}, score double").withColumn("held_out", F.expr(HELD_OUT))
