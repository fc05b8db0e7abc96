"""Packing of token pieces into fixed-length sequences by patterns fitted to the length histogram.

Patterns of at most three lengths that fill a sequence are enumerated; non-negative least squares fits how often each
is used; the counts are rounded down to what the histogram allows, and what remains goes best-fit, longest first, with
equal lengths handled together. The plan depends on the histogram alone (at most `length` numbers), so its cost does
not grow with the data. Pieces find their place by their rank among the pieces of the same length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from leafwork.llm.common import small_batches, stage
from leafwork.llm.encoder import encoder
from leafwork.llm.textbytes import buffers, chunks, give_back, tidy

FILES = 8  # of the counts by task and length


def patterns(lengths: np.ndarray, full: int) -> np.ndarray:
    """All a >= b >= c >= 0 from lengths (0: none) with a + b + c = full, as rows."""
    there = np.zeros(full + 1, bool)
    there[lengths] = True
    a, b = (x.ravel() for x in np.meshgrid(lengths, np.append(lengths, 0), indexing="ij"))
    c = full - a - b
    ok = (a >= b) & (b >= c) & (c >= 0)
    a, b, c = a[ok], b[ok], c[ok]
    ok = there[c] | (c == 0)
    return np.stack([a[ok], b[ok], c[ok]], 1)


def least_squares(rows: np.ndarray, histogram: np.ndarray, steps: int = 1500) -> np.ndarray:
    """x >= 0 that minimises the weighted distance of sum(x * pattern) from the histogram; accelerated projected gradient."""
    full = len(histogram) - 1
    weight = np.sqrt(np.arange(full + 1) / full)  # a long piece that stays over costs a sequence
    weight[0] = 0
    scale = max(1.0, histogram.max())
    want = histogram / scale

    def times(x):
        return sum(np.bincount(rows[:, k], x, full + 1) for k in range(3))

    def back(r):
        return r[rows[:, 0]] + r[rows[:, 1]] + r[rows[:, 2]]

    w2 = weight**2
    v = np.ones(len(rows))
    for _ in range(30):
        v = back(w2 * times(v))
        norm = np.linalg.norm(v)
        v /= norm
    rate = 1 / (1.05 * norm)
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(steps):
        nxt = np.maximum(0, y - rate * back(w2 * (times(y) - want)))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = nxt + (t - 1) / t2 * (nxt - x)
        x, t = nxt, t2
    return x * scale


def plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how often) that use up the histogram (counts by length, index 0 unused) exactly."""
    full = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[tuple[int, ...], int]] = []
    if left[full]:
        out.append(((full,), int(left[full])))
        left[full] = 0
    lengths = np.flatnonzero(left)
    rows = patterns(lengths, full) if len(lengths) else np.zeros((0, 3), np.int64)
    if len(rows):
        x = least_squares(rows, left.astype(float))

        def use(k: int, times: int):
            own = [int(v) for v in rows[k] if v]
            for v in set(own):
                times = min(times, int(left[v]) // own.count(v))
            if times > 0:
                for v in own:
                    left[v] -= times
                out.append((tuple(own), times))

        for k in np.argsort(-x, kind="stable"):
            if x[k] < 1:
                break
            use(k, int(x[k]))
        rest = x - np.floor(x)
        for k in np.argsort(-rest, kind="stable"):
            if rest[k] < 0.05:
                break
            use(k, 1)
    # best fit of the rest, longest first; open: free space -> [lengths, how many such sequences]
    open_: dict[int, list[list]] = {}
    for v in range(full, 0, -1):
        n = int(left[v])
        while n:
            gap = min((g for g in open_ if g >= v), default=None)
            if gap is None:
                per = full // v
                whole, part = divmod(n, per)
                for k, times in ((per, whole), (part, 1)):
                    if k and times:
                        open_.setdefault(full - k * v, []).append([(v,) * k, times])
                break
            own, times = open_[gap].pop()
            if not open_[gap]:
                del open_[gap]
            per = min(gap // v, n)
            used = min(times, n // per)
            if times > used:
                open_.setdefault(gap, []).append([own, times - used])
            open_.setdefault(gap - per * v, []).append([own + (v,) * per, used])
            n -= used * per
    out += [(own, times) for kept in open_.values() for own, times in kept]
    return out


def pieces(docs: DataFrame, tokenizer: str, full: int = 1024, end_id: int = 2, added: bool = False, with_ids: bool = True) -> DataFrame:
    """The documents' pieces, staged: doc_id, piece, start, length, [ids (bytes of uint32),] ids_crc32, part, local.

    A document is its ids and end_id (a null or empty text: end_id alone); only a longer one than `full` is cut, so
    that all its pieces but the first are full. `local` counts the pieces of one length in their task, `part`. Rows that
    share a doc_id, or have none, are documents of their own; columns beside doc_id and text are left aside.
    """
    small_batches(docs.sparkSession)

    def cut(batches):
        enc = encoder(tokenizer, added)
        part, seen = TaskContext.get().partitionId(), np.zeros(full + 1, np.int64)
        for batch in batches:
            texts = batch.column("text")
            doc_id = batch.column("doc_id").to_numpy(zero_copy_only=False)
            null = np.asarray(batch.column("doc_id").is_null())
            for a, b in chunks(buffers(texts)[1], 2 << 20):
                ids, ends = enc.encode(texts.slice(a, b - a))
                n = np.diff(ends) + 1
                stream = np.empty(len(ids) + b - a, "<u4")
                stop = np.cumsum(n)
                gap = np.ones(len(stream), bool)
                gap[stop - 1] = False
                stream[stop - 1] = end_id
                stream[gap] = ids
                count = -(-n // full)
                doc = np.repeat(np.arange(b - a), count)
                k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                first = n - (count - 1) * full
                start = np.where(k == 0, 0, first[doc] + (k - 1) * full)
                length = np.where(k == 0, first[doc], full)
                order = np.argsort(length, kind="stable")
                own = length[order]
                turn = np.empty(len(doc), np.int64)
                turn[order] = np.arange(len(doc)) - np.searchsorted(own, own)
                local = seen[length] + turn
                seen += np.bincount(length, minlength=full + 1)
                at = np.concatenate([[0], np.cumsum(length)]) * 4
                data = stream.tobytes()
                crc = [zlib.crc32(data[at[i] : at[i + 1]]) for i in range(len(doc))]
                out = {"doc_id": pa.array(doc_id[a:b][doc], pa.int64(), mask=null[a:b][doc]), "piece": pa.array(k, pa.int32()), "start": start, "length": length}
                if with_ids:
                    out["ids"] = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_pydict(out | {"ids_crc32": pa.array(crc, pa.int64()), "part": pa.array(np.full(len(doc), part)), "local": local})

    kind = f"doc_id long, piece int, start long, length long, {'ids binary, ' * with_ids}ids_crc32 long, part long, local long"
    return stage(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(cut), kind), "pieces")


def place(cut: DataFrame, full: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to staged pieces; offsets in a sequence are gapless from 0.

    A piece's rank among those of its length is its task's first rank (a running sum of counts by task) plus `local`.
    """
    small_batches(cut.sparkSession)
    # a few figures a task go into few files: around writes an executor starts helpers, which share its memory at first
    counts = stage(cut.groupBy("part", "length").count().coalesce(FILES), "lengths")
    histogram = np.zeros(full + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect():  # at most `full` rows
        histogram[r["length"]] = r["n"]
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    used = np.zeros(full + 1, np.int64)
    slots, sequence = [], 0
    for own, times in plan(histogram):
        offset = 0
        for v in own:
            slots.append((v, used[v], sequence, offset))
            used[v] += times
            offset += v
        sequence += times
    assert (used == histogram).all()
    give_back()
    # a slot: the pieces of a length from a rank on go to the sequences from one on, at one offset; bounded as the plan is
    slots = np.array(sorted(slots), np.int64).reshape(-1, 4)
    key = slots[:, 0] * (1 << 48) + slots[:, 1]

    def found(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            k = np.searchsorted(key, length * (1 << 48) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(c for name, c in zip(batch.schema.names, batch.columns) if name != "rank"), pa.array(slots[k, 2] + rank - slots[k, 1]), pa.array(slots[k, 3])],
                [*(n for n in batch.schema.names if n != "rank"), "sequence_id", "offset"],
            )

    ranked = cut.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("local")).drop("base", "part", "local")
    kind = ", ".join(f"`{n}` {t}" for n, t in ranked.drop("rank").dtypes)
    return ranked.mapInArrow(found, f"{kind}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, full: int = 1024, end_id: int = 2, with_ids: bool = True, added: bool = False) -> DataFrame:
    """doc_id, piece, start, length, [ids,] ids_crc32, sequence_id, offset of every piece of docs (doc_id, text); added: see Encoder."""
    return place(pieces(docs, tokenizer, full, end_id, added, with_ids), full)
