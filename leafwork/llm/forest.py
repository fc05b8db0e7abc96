"""Embedding near-duplicates by a forest of random-projection trees with spill.

Each tree splits the unit sphere at medians along random directions; a vector near a split goes to both sides. The
width of that band follows from the angle searched for: two vectors at the threshold are apart by `gap` along a random
direction (one deviation), the band takes SPILL of it, and several trees make up for the pairs that still part. A tree
is grown in rounds: the first from a bounded sample of all vectors, the next, where a leaf holds far more than LEAF of
them, from a sample of that leaf, so leaves stay small at any number of vectors. Vectors are compared within leaves; a
leaf that cannot be split (a large group of near copies) is cut into tiles and every pair of tiles is a task.
A link counts in the first leaf that both vectors share, so the links of a vector are added up without ever being rows;
of a leaf's links only enough to join its components leave the task. Equal vectors are one class.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leafwork.llm.common import components, discard, small_batches, stage
from leafwork.llm.vectors import dots, main_dimension, matrix, usable

TREES = 8
LEAF = 256
TILE = 1024
SPILL = 0.4
SAMPLE = 16_384
DIRECTIONS = 16
ROUNDS = 3
_BITS = 12  # of a leaf's name for each round


@dataclass
class Tree:
    """Nodes in depth-first order: direction, bound, children; a leaf has a number instead."""

    direction: list
    bound: list
    child: list
    spill: float

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of unit rows; a row is in several leaves where it is close to splits."""
        rows, leaf, todo = [], [], [(0, np.arange(len(x)))]
        while todo:
            k, own = todo.pop()
            if not len(own):
                continue
            if self.child[k] is None:
                rows.append(own)
                leaf.append(np.full(len(own), k))
                continue
            off = x[own] @ self.direction[k] - self.bound[k]
            todo += [(self.child[k][0], own[off <= self.spill]), (self.child[k][1], own[off > -self.spill])]
        return (np.concatenate(rows), np.concatenate(leaf)) if rows else (np.zeros(0, int), np.zeros(0, int))


def grow(sample: np.ndarray, total: int, rng: np.random.Generator, gap: float, leaf: int = LEAF, spill: float = SPILL, least: int = 32) -> Tree:
    """A tree whose leaves hold about `leaf` of `total` vectors; it ends earlier where fewer than `least` sampled remain,
    or where they lie within a few gaps of each other, so that a split would part what belongs together."""
    t = Tree([], [], [], spill * gap)

    def node(own: np.ndarray, depth: int) -> int:
        k = len(t.child)
        t.direction.append(None), t.bound.append(0.0), t.child.append(None)
        if len(own) * total / max(1, len(sample)) <= leaf or len(own) < min(least, len(sample)) or depth >= 40 or k >= (1 << _BITS) - 4:
            return k
        u = rng.normal(size=(DIRECTIONS, sample.shape[1]))
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        p = sample[own] @ u.T
        bound = np.median(p, axis=0)
        band = (np.abs(p - bound) <= t.spill).mean(0)
        band[p.std(0) < 3 * gap] = 1
        best = int(band.argmin())  # the direction with the fewest vectors near its split
        p, b = p[:, best], float(bound[best])
        low, high = own[p <= b + t.spill], own[p > b - t.spill]
        if band[best] >= 1 or max(len(low), len(high)) > 0.9 * len(own):
            return k
        t.direction[k], t.bound[k] = u[best].astype(np.float32), b
        t.child[k] = (node(low, depth + 1), node(high, depth + 1))
        return k

    node(np.arange(len(sample)), 0)
    return t


def unit(vec: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by powers of two first, so that no square overflows."""
    vec = np.ldexp(vec, -np.frexp(np.abs(vec).max(1, initial=0))[1][:, None]) if len(vec) else vec
    return vec / np.sqrt(dots(vec, vec))[:, None] if len(vec) else vec


def _homes(classes: DataFrame, total: int, main: int, gap: float, trees: int, leaf: int, spill: float, sample: int, seed: int) -> DataFrame:
    """class, home of every leaf that holds a vector, staged; home: tree, then the leaf's number in each round."""
    spark = classes.sparkSession
    picked = classes.filter(F.size("embedding") == main).orderBy(F.xxhash64(F.lit(seed), "class"), "class").limit(sample).select("embedding").toArrow()  # bounded
    x = unit(matrix(picked.column("embedding")))
    rng = np.random.default_rng(seed)
    held = spark.sparkContext.broadcast([grow(x, total, rng, gap, leaf, spill) for _ in range(trees)])  # bounded by the sample

    def spread(batches):
        for batch in batches:
            size = np.array([len(e) for e in batch.column("embedding").to_pylist()])
            for d in np.unique(size):
                own = batch.filter(pa.array(size == d))
                name = own.column("class").to_numpy()
                if d != main:  # of another length than most: a leaf of their own
                    yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(np.full(len(name), (trees + int(d)) << _BITS * ROUNDS))], ["class", "home"])
                    continue
                x = unit(matrix(own.column("embedding")))
                for t, tree in enumerate(held.value):
                    at, leaf = tree.leaves(x)
                    yield pa.RecordBatch.from_arrays([pa.array(name[at]), pa.array((t << _BITS * ROUNDS) + (leaf.astype(np.int64) << _BITS * (ROUNDS - 1)))], ["class", "home"])

    homes = stage(classes.select("class", "embedding").mapInArrow(spread, "class long, home long"), "homes")
    for turn in range(1, ROUNDS):
        shift = _BITS * (ROUNDS - 1 - turn)
        sizes = homes.groupBy("home").agg(F.count("*").alias("members")).filter((F.col("members") > 4 * leaf) & (F.shiftright("home", _BITS * ROUNDS) < trees))
        sizes = stage(sizes, "large")
        if sizes.isEmpty():
            break
        rows = homes.join(sizes, "home").join(classes.select("class", "embedding"), "class")

        def fit(t: pa.Table) -> pa.Table:
            home = t.column("home")[0].as_py()
            t = t.take(pa.array(np.argsort(t.column("class").to_numpy(), kind="stable")))
            tree = grow(unit(matrix(t.column("embedding"))), t.column("members")[0].as_py(), np.random.default_rng([seed, home]), gap, leaf, spill)
            return pa.table({"home": pa.array([home]), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

        def place(t: pa.Table, fitted: pa.Table) -> pa.Table:
            if not t.num_rows or not fitted.num_rows:
                return pa.table({"class": pa.array([], pa.int64()), "home": pa.array([], pa.int64())})
            at, leaf = pickle.loads(fitted.column("tree")[0].as_py()).leaves(unit(matrix(t.column("embedding"))))
            return pa.table({"class": t.column("class").to_numpy()[at], "home": t.column("home")[0].as_py() + (leaf.astype(np.int64) << shift)})

        chosen = rows.filter(F.expr(f"pmod(xxhash64({seed}, class), ceil(members / {sample})) = 0"))
        subtrees = chosen.groupBy("home").applyInArrow(fit, "home long, tree binary").join(sizes, "home")
        chunks = F.expr("int(ceil(members / 65536))")
        dealt = rows.withColumn("chunk", F.expr("int(pmod(xxhash64(1, class), ceil(members / 65536)))"))
        spread_trees = subtrees.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
        finer = dealt.select("home", "chunk", "class", "embedding").groupBy("home", "chunk").cogroup(spread_trees.select("home", "chunk", "tree").groupBy("home", "chunk"))
        finer = finer.applyInArrow(place, "class long, home long")
        after = stage(homes.join(sizes.select("home"), "home", "left_anti").select("class", "home").union(finer), "homes")
        discard(homes, sizes)
        homes = after
    return homes


def near_vectors(rows: DataFrame, cosine: float = 0.98, trees: int = TREES, spill: float = SPILL, leaf: int = LEAF, sample: int = SAMPLE, tile: int = TILE, seed: int = 4) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding, label).

    A row whose vector is null, empty, zero or has null or non-finite components, or whose label is null, is linked
    with nothing. Vectors of different lengths are never linked; those of another length than most are compared
    exhaustively. A null vec_id never names a component with other ids. Repeated rows count as vectors of their own.
    Other columns are left aside; an empty table has no rows.
    """
    spark = rows.sparkSession
    small_batches(spark)
    kind = "float" if dict(rows.dtypes)["embedding"] == "array<float>" else "double"
    base = rows.select(F.col("vec_id").cast("long"), F.col("label"), F.col("embedding").cast(f"array<{kind}>"))
    named = base.withColumn("class", F.when(usable() & F.col("label").isNotNull(), F.xxhash64("label", "embedding")))
    classes = named.filter("class IS NOT NULL").groupBy("class", "label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    classes = stage(classes.withColumn("mark", F.xxhash64("label")), "classes")
    total, main = classes.count(), main_dimension(classes)
    gap = float(np.sqrt(max(0.0, 2 - 2 * cosine) / max(1, main)))
    homes = _homes(classes, total, main, gap, trees, leaf, spill, sample, seed)
    all_homes = homes.groupBy("class").agg(F.array_sort(F.collect_list("home")).alias("homes"))  # a few for each vector
    sizes = homes.groupBy("home").agg(F.expr(f"int(ceil(count(*) / {tile}))").alias("tiles"))
    rows_ = classes.select("class", "mark", "copies", "embedding").join(all_homes, "class").withColumn("home", F.explode("homes"))
    tiled = rows_.join(sizes, "home").withColumn("tile", F.expr("int(pmod(xxhash64(5, class), tiles))"))
    # a row of tile i goes to the pairs (i, j) with j >= i and (j, i) with j < i
    pairs = tiled.withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)"))).withColumn("i", F.least("tile", "other")).withColumn("j", F.greatest("tile", "other"))

    def compare(t: pa.Table) -> pa.Table:
        home, i, j = (t.column(c)[0].as_py() for c in ("home", "i", "j"))
        name, mark, copies, part = (t.column(c).to_numpy() for c in ("class", "mark", "copies", "tile"))
        x = unit(matrix(t.column("embedding")))
        lists = t.column("homes").combine_chunks()
        count = np.diff(lists.offsets.to_numpy())
        own = np.full((len(name), int(count.max())), -1)
        own[np.arange(own.shape[1])[None] < count[:, None]] = lists.flatten().to_numpy()
        own[own >= home] = -1  # leaves before this one
        left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
        degree, a, b = np.zeros(len(name), np.int64), [], []
        for s in range(0, len(left), 512):
            l = left[s : s + 512]
            p, q = np.nonzero((x[l] @ x[right].T >= cosine - 1e-6) & (mark[l][:, None] == mark[right][None]))
            p, q = l[p], right[q]
            ok = name[p] < name[q] if i == j else np.ones(len(p), bool)
            p, q = p[ok], q[ok]
            ok = np.zeros(len(p), bool)
            for k in range(0, len(p), 1 << 16):  # the same double precision sum everywhere; and no earlier leaf shared
                u, v = p[k : k + (1 << 16)], q[k : k + (1 << 16)]
                seen = np.zeros(len(u), bool)
                for c in range(own.shape[1]):
                    seen |= ((own[u, c][:, None] == own[v]) & (own[u, c] >= 0)[:, None]).any(1)
                ok[k : k + (1 << 16)] = ~seen & (dots(x[u], x[v]) >= cosine)
            a.append(p[ok]), b.append(q[ok])
        a, b = np.concatenate([*a, np.zeros(0, np.int64)]), np.concatenate([*b, np.zeros(0, np.int64)])
        np.add.at(degree, a, copies[b])
        np.add.at(degree, b, copies[a])
        root = np.arange(len(name))
        while True:  # the smallest row reachable within the task
            before = root.copy()
            np.minimum.at(root, a, before[b])
            np.minimum.at(root, b, before[a])
            root = np.minimum(root, root[root])
            if (root == before).all():
                break
        use = np.flatnonzero(degree)
        return pa.table({"class": name[use], "near": degree[use], "root": name[root[use]]})

    links = pairs.select("home", "i", "j", "tile", "class", "mark", "copies", "embedding", "homes").groupBy("home", "i", "j").applyInArrow(compare, "class long, near long, root long")
    links = stage(links, "links")
    copies = classes.select("class", "copies", "vec_id")
    degree = links.groupBy("class").agg(F.sum("near").alias("near"))
    found = components(links.select(F.col("class").alias("a"), F.col("root").alias("b")))
    named_classes = copies.join(degree, "class", "left").join(found.withColumnRenamed("id", "class"), "class", "left")
    named_classes = named_classes.withColumn("component", F.coalesce("component", "class")).withColumn("n_links", F.col("copies") - 1 + F.coalesce("near", F.lit(0)))
    least = named_classes.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    label = stage(named_classes.join(least, "component").select("class", "n_links", "component_id"), "named")
    discard(homes, links, classes)
    out = named.select("vec_id", "class").join(label, "class", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "vec_id")).withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    return out.select("vec_id", "n_links", "component_id", F.expr("vec_id <=> component_id OR vec_id IS NULL").alias("kept"))
