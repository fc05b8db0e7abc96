"""Nearest neighbours by learned partitions.

The nearest-neighbour graph of a bounded sample is cut into balanced parts; a small network learns to name a vector's
part. Every row is indexed under its likeliest part; a query goes to its several most probable parts, as many as hold
COVER of the neighbours of sampled rows left out of training. A part with far more than PART rows is cut again in the
same way by a network of its own, learnt from a sample of its rows, so parts stay small at any number of rows. The rows
of a query's parts are ranked exactly. Parts are split into blocks by a hash, so none is capped.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leafwork.llm.common import discard, small_batches, stage
from leafwork.llm.textbytes import buffers
from leafwork.llm.vectors import dots, main_dimension, matrix, usable

SAMPLE = 8192
PART = 1024  # rows a part is meant to hold
FEWEST, FAN = 8, 64  # parts that one network tells apart
BLOCK = 4096
COVER = 0.95  # share of the sample's neighbours that the routed parts must hold


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """Each row's k largest inner products with other rows."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for s in range(0, len(x), 1024):
        near = x[s : s + 1024] @ x.T
        near[np.arange(len(near)), np.arange(s, s + len(near))] = -np.inf
        out[s : s + 1024] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, parts: int, rng: np.random.Generator, sweeps: int = 4) -> np.ndarray:
    """Parts of nearly equal size with few edges between them: recursive halving along the graph's slow vector, then swaps."""
    n, k = graph.shape
    a, b = np.repeat(np.arange(n), k), graph.ravel()
    label = np.zeros(n, np.int64)

    def halve(own: np.ndarray, lo: int, hi: int):
        if hi - lo <= 1 or len(own) < 2:
            label[own] = lo
            return
        mid = (lo + hi) // 2
        inside = np.full(n, -1)
        inside[own] = np.arange(len(own))
        p, q = inside[a], inside[b]
        ok = (p >= 0) & (q >= 0)
        p, q = np.concatenate([p[ok], q[ok]]), np.concatenate([q[ok], p[ok]])
        degree = np.bincount(p, minlength=len(own)) + 1.0
        v = rng.normal(size=len(own))
        for _ in range(40):
            v = (np.bincount(p, v[q], len(own)) + v) / degree
            v -= np.average(v, weights=degree)
            v /= np.linalg.norm(v) + 1e-30
        side = np.zeros(len(own), bool)
        side[np.argsort(v, kind="stable")[round(len(own) * (mid - lo) / (hi - lo)) :]] = True
        for _ in range(sweeps):  # swap the rows that gain most by changing sides
            to = np.bincount(p, side[q], len(own)) * 2.0 - (degree - 1)
            gain = np.where(side, -to, to)
            left, right = (np.flatnonzero(~side), np.flatnonzero(side))
            left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
            m = min(len(left), len(right))
            m = int(np.sum(gain[left[:m]] + gain[right[:m]] > 1)) // 2
            if not m:
                break
            side[left[:m]], side[right[:m]] = True, False
        halve(own[~side], lo, mid)
        halve(own[side], mid, hi)

    halve(np.arange(n), 0, parts)
    return label


@dataclass
class Router:
    """One hidden layer: rows -> log probabilities of the parts."""

    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(0, x * self.scale @ self.w1 + self.b1) @ self.w2 + self.b2


def train(x: np.ndarray, goal: np.ndarray, rng: np.random.Generator, hidden: int = 96, steps: int = 500) -> Router:
    """Adam on the cross entropy with goal, each row's shares of its neighbours' parts."""
    d, parts = x.shape[1], goal.shape[1]
    scale = float(1 / (np.sqrt((x**2).mean()) + 1e-30))
    w = [rng.normal(0, np.sqrt(2 / d), (d, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
    m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    for step in range(1, steps + 1):
        own = rng.integers(0, len(x), min(len(x), 512))
        z = x[own] * scale
        h = np.maximum(0, z @ w[0] + w[1])
        o = h @ w[2] + w[3]
        o = np.exp(o - o.max(1, keepdims=True))
        r = (o / o.sum(1, keepdims=True) - goal[own]) / len(own)
        back = (r @ w[2].T) * (h > 0)
        for p, g in enumerate((z.T @ back, back.sum(0), h.T @ r, r.sum(0))):
            g = g + 1e-5 * w[p]
            m[p] = 0.9 * m[p] + 0.1 * g
            v[p] = 0.999 * v[p] + 0.001 * g * g
            w[p] = w[p] - 0.01 * (m[p] / (1 - 0.9**step)) / (np.sqrt(v[p] / (1 - 0.999**step)) + 1e-8)
    return Router(scale, *w)


@dataclass
class Index:
    router: Router | None  # None: too few rows to learn from, one part
    routes: int
    cover: float

    def parts(self, x: np.ndarray, routes: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, part from 0) of the likeliest parts of each row."""
        if self.router is None:
            return np.arange(len(x)), np.zeros(len(x), np.int64)
        order = np.argsort(-self.router.logits(x), axis=1, kind="stable")[:, :routes]
        return np.repeat(np.arange(len(x)), order.shape[1]), order.ravel()


def learn(x: np.ndarray, total: int, cover: float, rng: np.random.Generator, part: int = PART, k: int = 20) -> Index:
    """Parts and routes from sampled rows x of `total`; routes: the fewest parts that hold `cover` of the neighbours of rows left out of training."""
    parts = int(min(FAN, max(FEWEST, -(-total // part)), len(x) // 16))
    if parts < 2:
        return Index(None, 1, 1.0)
    graph = neighbours(x, k)
    label = balanced_parts(graph[:, :10], parts, rng)
    goal = np.zeros((len(x), parts))
    np.add.at(goal, (np.arange(len(x))[:, None], label[graph]), 1.0)
    goal[np.arange(len(x)), label] += k / 2
    goal /= goal.sum(1, keepdims=True)
    held = rng.permutation(len(x))[: max(1, len(x) // 8)]
    taught = np.setdiff1d(np.arange(len(x)), held)
    router = train(x[taught], goal[taught], rng)
    own = router.logits(x).argmax(1)
    place = np.argsort(np.argsort(-router.logits(x[held]), axis=1), axis=1)
    rank = place[np.arange(len(held))[:, None], own[graph[held]]]
    share = np.array([(rank < m).mean() for m in range(1, parts + 1)])
    routes = int(np.argmax(share >= cover)) + 1
    return Index(router, routes, float(share[routes - 1]))


def _rounds(total: int, part: int) -> int:
    n = 1
    while part * FAN**n < total:
        n += 1
    return n


def fit(vectors: DataFrame, total: int, dimension: int, cover: float, sample: int = SAMPLE, part: int = PART, seed: int = 8) -> Index:
    """The first cut, learnt from at most `sample` different vectors."""
    picked = vectors.filter(F.size("embedding") == dimension).select("embedding").distinct().orderBy(F.xxhash64(F.lit(seed), "embedding"), "embedding").limit(sample).toArrow()
    return learn(matrix(picked.column("embedding")), total, cover, np.random.default_rng(seed), part)


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of doubles as binary values."""
    ends = pa.py_buffer((np.arange(len(rows) + 1) * 8 * rows.shape[1]).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, ends, pa.py_buffer(np.ascontiguousarray(rows, "<f8"))])


def _doubles(column) -> np.ndarray:
    """Binary values of one length as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    raw, offsets = buffers(column)
    return np.frombuffer(raw, "<f8").reshape(len(offsets) - 1, -1)


def placed(rows: DataFrame, queries: DataFrame, sample: int = SAMPLE, part: int = PART, cover: float = COVER, seed: int = 8) -> DataFrame:
    """vec_id, asks, part, vector, staged: each row under its likeliest part, each query under its most probable ones."""
    spark, total, dimension = rows.sparkSession, rows.count(), main_dimension(rows)
    rounds = _rounds(total, part)
    each = cover ** (1 / rounds)
    held = spark.sparkContext.broadcast(fit(rows, total, dimension, each, sample, part, seed))

    def first(batches):
        for batch in batches:
            size = np.array([len(e) for e in batch.column("embedding").to_pylist()])
            for d in np.unique(size):
                for asks in (False, True):
                    own = batch.filter(pa.array((size == d) & (batch.column("asks").to_numpy(zero_copy_only=False) == asks)))
                    if not own.num_rows:
                        continue
                    x = matrix(own.column("embedding"))
                    at, to = held.value.parts(x, held.value.routes if asks else 1) if d == dimension else (np.arange(len(x)), np.full(len(x), -1 - int(d)))
                    yield pa.RecordBatch.from_arrays([own.column("vec_id").take(pa.array(at)), pa.array(np.full(len(at), asks)), pa.array(to.astype(np.int64) + 1), _binary(x[at])], ["vec_id", "asks", "part", "vector"])

    kind = "vec_id long, asks boolean, part long, vector binary"
    both = rows.withColumn("asks", F.lit(False)).union(queries.withColumn("asks", F.lit(True)))
    out = stage(both.mapInArrow(first, kind), "placed")
    for _ in range(1, rounds):
        sizes = stage(out.filter("NOT asks AND part > 0").groupBy("part").agg(F.count("*").alias("members")).filter(F.col("members") > 4 * part), "large")
        if sizes.isEmpty():
            break

        def cut(t: pa.Table) -> pa.Table:
            name = t.column("part")[0].as_py()
            x = np.unique(_doubles(t.column("vector")), axis=0)
            index = learn(x, t.column("members")[0].as_py(), each, np.random.default_rng([seed, name]), part)
            return pa.table({"part": pa.array([name]), "index": pa.array([pickle.dumps(index)], pa.binary())})

        def finer(t: pa.Table, index: pa.Table) -> pa.Table:
            found = []
            if t.num_rows and index.num_rows:
                own, name = pickle.loads(index.column("index")[0].as_py()), t.column("part")[0].as_py()
                x, asks = _doubles(t.column("vector")), t.column("asks").to_numpy()
                for a in (False, True):
                    rows_ = np.flatnonzero(asks == a)
                    at, to = own.parts(x[rows_], own.routes if a else 1)
                    take = pa.array(rows_[at])
                    found.append(pa.table({"vec_id": t.column("vec_id").take(take), "asks": t.column("asks").take(take), "part": pa.array(name * 256 + 1 + to), "vector": t.column("vector").take(take)}))
            return pa.concat_tables(found) if found else pa.schema([("vec_id", pa.int64()), ("asks", pa.bool_()), ("part", pa.int64()), ("vector", pa.binary())]).empty_table()

        large = out.join(sizes, "part")
        chosen = large.filter(F.expr(f"NOT asks AND pmod(xxhash64({seed}, vec_id), ceil(members / {sample})) = 0"))
        indexes = chosen.groupBy("part").applyInArrow(cut, "part long, index binary").join(sizes, "part")
        chunk = F.expr("int(ceil(members / 65536))")
        indexes = indexes.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunk - 1)))
        dealt = large.withColumn("chunk", F.expr("int(pmod(xxhash64(1, vec_id), ceil(members / 65536)))"))
        moved = dealt.select("part", "chunk", "vec_id", "asks", "vector").groupBy("part", "chunk").cogroup(indexes.select("part", "chunk", "index").groupBy("part", "chunk")).applyInArrow(finer, kind)
        after = stage(out.join(sizes.select("part"), "part", "left_anti").select("vec_id", "asks", "part", "vector").union(moved), "placed")
        discard(out, sizes)
        out = after
    return out


def search(rows: DataFrame, queries: DataFrame, top: int = 20, sample: int = SAMPLE, part: int = PART, cover: float = COVER, seed: int = 8) -> DataFrame:
    """query_id, rank, vec_id, score: each query's `top` rows of largest inner product, ties to the smaller vec_id.

    rows and queries are (vec_id, embedding); a query's own vec_id is no candidate. Vectors null, empty, zero or with
    null or non-finite components, and null ids, take no part. Vectors of another length than most meet exhaustively;
    those of different lengths never meet. Fewer candidates than `top`: all that the routed parts hold. Repeated rows
    are one candidate. Other columns are left aside; an empty table has no rows.
    """
    spark = rows.sparkSession
    small_batches(spark, 2000)
    clean = lambda df: df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).filter(usable() & F.col("vec_id").isNotNull())
    both = placed(clean(rows), clean(queries), sample, part, cover, seed)
    indexed, asked = both.filter("NOT asks").drop("asks"), both.filter("asks").drop("asks").toDF("vec_id", "part", "vector")
    blocks = indexed.groupBy("part").agg(F.expr(f"int(ceil(count(*) / {BLOCK}))").alias("blocks"))
    turns = asked.groupBy("part").agg(F.expr(f"int(ceil(count(*) / {BLOCK}))").alias("turns"))
    size = blocks.join(turns, "part")  # a row per part; as many as the rows ask for, so never broadcast by force
    left = indexed.join(size, "part").selectExpr("part", "int(pmod(xxhash64(1, vec_id), blocks)) AS block", "explode(sequence(0, turns - 1)) AS turn", "vec_id", "vector")
    right = asked.join(size, "part").selectExpr("part", "explode(sequence(0, blocks - 1)) AS block", "int(pmod(xxhash64(2, vec_id), turns)) AS turn", "vec_id", "vector")

    def rank(near: pa.Table, query: pa.Table) -> pa.Table:
        if not near.num_rows or not query.num_rows:
            kind = pa.list_(pa.struct([("worse", pa.float64()), ("vec_id", pa.int64())]))
            return pa.table({"query_id": pa.array([], pa.int64()), "best": pa.array([], kind)})
        ids, x = near.column("vec_id").to_numpy(), _doubles(near.column("vector"))
        # of equal vectors only the smallest ids can be among the nearest, and the query's own is none
        same = np.unique(x.view(f"V{8 * x.shape[1]}").ravel(), return_inverse=True)[1] if len(x) else np.zeros(0, int)
        order = np.lexsort((ids, same))
        place = np.arange(len(order)) - np.searchsorted(same[order], same[order])
        keep = order[place <= top]
        ids, x = ids[keep], x[keep]
        q, qid = _doubles(query.column("vector")), query.column("vec_id").to_numpy()
        out = [[], [], []]
        for s in range(0, len(q), 256):
            near_ = q[s : s + 256] @ x.T
            near_[qid[s : s + 256][:, None] == ids] = -np.inf
            m = min(top, len(ids))
            cut = np.partition(near_, len(ids) - m, axis=1)[:, len(ids) - m]
            slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(cut), cut, 0)))
            a, b = np.nonzero((near_ >= (cut - slack)[:, None]) & np.isfinite(near_))
            score = dots(q[s + a], x[b])
            best = np.lexsort((ids[b], -score, a))
            a, b, score = a[best], b[best], score[best]
            place = np.arange(len(a)) - np.searchsorted(a, a)
            ok = place < top
            out[0].append(qid[s + a[ok]]), out[1].append(ids[b[ok]]), out[2].append(score[ok])
        ask, own, score = (np.concatenate(v) for v in out)
        at = np.flatnonzero(np.concatenate([[True], ask[1:] != ask[:-1]])) if len(ask) else np.zeros(0, np.int64)
        ends = pa.array(np.append(at, len(ask)), pa.int32())
        best = pa.StructArray.from_arrays([pa.array(-score), pa.array(own, pa.int64())], ["worse", "vec_id"])
        return pa.table({"query_id": pa.array(ask[at], pa.int64()), "best": pa.ListArray.from_arrays(ends, best)})

    keys = ["part", "block", "turn"]
    kind = "query_id long, best array<struct<worse: double, vec_id: bigint>>"
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(rank, kind)
    # a row for each query and block; a query's lists, `top` long each, are merged by groups of blocks and then in one
    least = lambda column: F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(column)))), 1, top).alias("best")
    some = found.groupBy("query_id", F.expr("int(pmod(xxhash64(best), 16))").alias("some")).agg(least("best"))
    merged = some.groupBy("query_id").agg(least("best"))
    each = merged.select("query_id", F.posexplode("best").alias("rank", "b"))
    return each.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.worse")).alias("score"))
