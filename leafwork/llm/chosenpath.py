"""Near-duplicate documents by a chosen-path set similarity join over minwise tokens.

A set of word shingles is reduced to COORDINATES minwise tokens. A tree starts with all sets in one node; a node picks
one coordinate, and at times a second (4/3 on average, the inverse of the threshold), by its own name, and hands each
set to the child named by the set's token there. A node of at most SMALL sets is compared exhaustively and ends. A
larger one, a crowd, compares its sets with two pivots, and with one once there are components. The links of a level are confirmed and components joined before
the next: a node whose sets are all linked is done, and of the others only pairs across components matter. What is
still mixed branches on, but for tight crowds, whose sets agree with one of them in half of the tokens and more: branching
would hand most of their sets to one child and some to a second, in every tree. They are put aside; those around the same
set, from whatever trees and levels, are one crowd. Independent trees bring the recall to the target: a pair of similarity
0.75 shares a first child in one of 18 trees but for 0.25 ** 18. At level LEVELS branching stops, and what is still mixed
then or was put aside is compared exhaustively on full sets, tile against tile, whatever its size.
Pairs are screened by 192 bits of the minwise tokens (a true pair fails by chance once in 100,000) and confirmed on
full sets. Equal sets are one class throughout, so copies cost nothing, and no step gathers a large node in a task.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leafwork.llm.common import components, discard, small_batches, stage
from leafwork.llm.textbytes import U, buffers, chunks, mix, tidy, words

COORDINATES = 48
TREES = 18
SMALL = 24
LEVELS = 4
TILE = 256  # sets of a crowd that are compared with as many others in a task
VOLUME = 1 << 18  # shingles that they hold at most, about
SCREEN = 24  # of 48 tokens that agree in four bits; a pair of similarity 0.75 has 36.8 on average, deviation 2.9
_RNG = np.random.default_rng(75)
_STEP = _RNG.integers(1, 1 << 63, COORDINATES, dtype=U) | U(1)
_ADD = _RNG.integers(1, 1 << 63, COORDINATES, dtype=U)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct k-word shingles as sorted 64-bit hashes, and the rows' offsets among them."""
    hashes, _, _, at = words(raw, offsets)
    rows = len(offsets) - 1
    count = np.diff(at)
    with np.errstate(over="ignore"):
        if len(hashes) >= k:
            run = np.zeros(len(hashes) - k + 1, U)
            for j in range(k):
                run = run * U(0x9FB21C651E98DF25) + hashes[j : len(hashes) - k + 1 + j]
            run = mix(run)
        else:
            run = np.zeros(0, U)
        n = np.maximum(count - k + 1, 0)
        ends = np.cumsum(n)
        index = np.arange(ends[-1] if rows else 0) + np.repeat(at[:-1] - (ends - n), n)
        doc, value = np.repeat(np.arange(rows), n), run[index]
        few = np.flatnonzero((count > 0) & (count < k))
        if len(few):  # the whole sequence as one shingle
            own = []
            for d in few:
                h = U(count[d])
                for w in hashes[at[d] : at[d + 1]]:
                    h = h * U(0x9FB21C651E98DF25) + w
                own.append(h)
            doc = np.concatenate([doc, few])
            value = np.concatenate([value, mix(np.array(own, U))])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[fresh], value[fresh]
    return value, np.searchsorted(doc, np.arange(rows + 1))


def _names(value: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit names of each set, sums over its members: equal for equal sets."""
    names = []
    with np.errstate(over="ignore"):
        for salt in (U(0x1F83D9ABFB41BD6B), U(0x5BE0CD19137E2179)):
            run = np.concatenate([np.zeros(1, U), np.cumsum(mix(value ^ salt), dtype=U)])
            names.append(mix(run[at[1:]] - run[at[:-1]]).view(np.int64))
    return names[0], names[1]


def signatures(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, text_key (a hash of the text), n_shingles, set_id and name (of the set; null if empty), sketch (3 longs) and tokens of every document."""
    small_batches(docs.sparkSession)

    def sign(batches):
        for batch in batches:
            raw, offsets = buffers(batch.column("text"))
            doc_id = batch.column("doc_id")
            for a, b in chunks(offsets):
                value, at = shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                n = np.diff(at)
                full = n > 0
                tokens = np.zeros((b - a, COORDINATES), U)
                if full.any():
                    cut = at[:-1][full]
                    with np.errstate(over="ignore"):
                        for c in range(COORDINATES):
                            tokens[full, c] = np.minimum.reduceat(value * _STEP[c] + _ADD[c], cut)
                bits = mix(tokens) & U(15)
                sketch = np.zeros((b - a, COORDINATES // 16), U)
                for c in range(COORDINATES):
                    sketch[:, c // 16] |= bits[:, c] << U(4 * (c % 16))
                tokens = (tokens >> U(33)).astype(np.int32)
                lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), kind))
                set_id, name = _names(value, at)
                yield pa.RecordBatch.from_arrays(
                    [doc_id.slice(a, b - a).cast(pa.int64()), batch.column("text_key").slice(a, b - a), pa.array(n, pa.int64()), pa.array(set_id, mask=~full), pa.array(name, mask=~full), lists(sketch.view(np.int64), pa.int64()), lists(tokens, pa.int32())],
                    ["doc_id", "text_key", "n_shingles", "set_id", "name", "sketch", "tokens"],
                )

    kind = "doc_id long, text_key long, n_shingles long, set_id long, name long, sketch array<bigint>, tokens array<int>"
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(tidy(sign), kind)


def _apart_sql(a: str, b: str) -> str:
    """In how many places two sketches differ."""
    parts = []
    for k in range(COORDINATES // 16):
        x = f"({a}[{k}] ^ {b}[{k}])"
        y = f"({x} | shiftrightunsigned({x}, 1))"
        parts.append(f"bit_count(({y} | shiftrightunsigned({y}, 2)) & {0x1111111111111111}L)")
    return " + ".join(parts)


def _alike_sql(a: str, b: str) -> str:
    """Whether two sketches agree in enough places and the sets' sizes allow the similarity."""
    size = f"least({a}.n, {b}.n) * 100 >= greatest({a}.n, {b}.n) * 75"
    return f"({size} AND {_apart_sql(f'{a}.sketch', f'{b}.sketch')} <= {COORDINATES - SCREEN})"


def _alike(a: str, b: str) -> F.Column:
    return F.expr(_alike_sql(a, b))


def roots(classes: DataFrame, trees: int = TREES) -> DataFrame:
    """node, set_id, n, sketch: each set's first node in every tree; the trees' first levels differ in their coordinates."""
    step = max(1, COORDINATES // trees)
    return classes.selectExpr(f"explode(transform(sequence(0, {trees - 1}), t -> xxhash64(t, tokens[int(pmod(t * {step}, {COORDINATES}))]))) AS node", "set_id", "n", "sketch")


def _branch(rows: DataFrame) -> DataFrame:
    """Each set's children of its node; the node's name picks the coordinates."""
    c = COORDINATES
    return rows.selectExpr(
        "explode(transform(IF(pmod(xxhash64(7, node), 3) = 0, array(pmod(xxhash64(11, node), {0}), pmod(xxhash64(11, node) + 1 + pmod(xxhash64(13, node), {0} - 1), {0})), array(pmod(xxhash64(11, node), {0}))),"
        " c -> xxhash64(node, c, tokens[int(c)]))) AS node".format(c),
        "set_id", "n", "sketch", "tokens",
    )


def _named(rows: DataFrame, label: DataFrame | None) -> DataFrame:
    """Adds each set's component, itself where it isn't linked yet."""
    if label is None:
        return rows.withColumn("component", F.col("set_id"))
    return rows.join(label.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))


def _several(rows: DataFrame, label: DataFrame | None, **told: F.Column) -> DataFrame:
    """The rows of nodes that hold several components, with their component and what is told of the node."""
    named = _named(rows, label)
    found = named.groupBy("node").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), *(c.alias(k) for k, c in told.items()))
    return named.join(found.filter("lo <> hi").select("node", *told), "node")


def _pivot(*salt) -> F.Column:
    """A member of the node; a linked set comes first: in a crowd it stands for most of the others."""
    alone = F.col("component") == F.col("set_id")
    return F.min(F.struct(alone.alias("alone"), F.xxhash64(*salt, "set_id").alias("h"), "component", "set_id", "n", "sketch"))


def _mixed(rows: DataFrame, label: DataFrame | None) -> DataFrame:
    """The rows of nodes that hold several components, with their component, the node's members and two pivots."""
    return _several(rows, label, members=F.count("*"), p=_pivot(F.lit(1), "node"), q=_pivot(F.lit(2), "node"))


def _tight(crowd: DataFrame) -> DataFrame:
    """node, around (a set) of the crowds whose sets agree with their pivot m in half of the tokens or more, on average."""
    apart = F.avg(F.expr(_apart_sql("sketch", "m.sketch")))
    return crowd.groupBy("node").agg(apart.alias("apart"), F.first("m.set_id").alias("around")).filter(F.col("apart") <= COORDINATES // 2).select("node", "around")


_FIELDS = ["set_id", "n", "sketch", "component"]


def _pairs(met: DataFrame, small: int, pivots: str) -> DataFrame:
    """a, b and their components ca, cb: screened pairs across components, all of a small node's and a crowd's with its pivots (p, q)."""
    few = met.filter(F.col("members") <= small).groupBy("node").agg(F.sort_array(F.collect_list(F.struct(*_FIELDS))).alias("m")).select(F.posexplode("m").alias("i", "x"), "m")
    # pairs that fail are never made rows of their own
    few = few.select("x", F.explode(F.expr(f"filter(slice(m, i + 2, size(m)), y -> x.component <> y.component AND {_alike_sql('x', 'y')})")).alias("y"))
    star = met.filter(F.col("members") > small).select(F.struct(*_FIELDS).alias("x"), "p", "q")
    star = star.select("x", F.explode(F.expr(f"filter(array({pivots}), y -> x.component <> y.component AND {_alike_sql('x', 'y')})")).alias("y"))
    both = few.select("x.*", F.struct("y.set_id", "y.component").alias("y")).union(star.select("x.*", F.struct("y.set_id", "y.component").alias("y")))
    return _ordered(both.selectExpr("set_id AS a", "y.set_id AS b", "component AS ca", "y.component AS cb"))


def _ordered(pairs: DataFrame) -> DataFrame:
    """Each pair once, the smaller id first."""
    return pairs.selectExpr("least(a, b) AS a", "greatest(a, b) AS b", "if(a < b, ca, cb) AS ca", "if(a < b, cb, ca) AS cb").distinct()


def _across(crowd: DataFrame, sets: DataFrame, tile: int = TILE, volume: int = VOLUME) -> DataFrame:
    """a, b, ca, cb of all pairs of a crowd (node, set_id, n, component) across components whose full sets are similar.

    A node's sets are dealt into tiles, each pair of tiles is a task's work of bounded size, and only links leave it.
    """
    size = crowd.groupBy("node").agg(F.expr(f"int(greatest(ceil(count(*) / {tile}), ceil(sum(n) / {volume})))").alias("tiles"))
    own = crowd.join(size, "node").withColumn("tile", F.expr("int(pmod(xxhash64(3, set_id), tiles))")).join(sets, "set_id")
    own = own.withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)"))).select("node", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "set_id", "component", "shingles")

    def compare(t: pa.Table) -> pa.Table:
        name, part, tile = (t.column(c).to_numpy() for c in ("set_id", "component", "tile"))
        lists = t.column("shingles").combine_chunks()
        at = lists.offsets.to_numpy().astype(np.int64)
        x, y = np.flatnonzero(tile == t.column("i")[0].as_py()), np.flatnonzero(tile == t.column("j")[0].as_py())
        value = lists.flatten().to_numpy()
        owner = np.repeat(np.arange(len(name)), np.diff(at))
        shared = np.unique(value, return_inverse=True)[1]
        place = np.full(len(name), -1)
        place[x] = np.arange(len(x))
        other = np.full(len(name), -1)
        other[y] = np.arange(len(y))
        common = np.zeros((len(x), len(y)), np.float32)
        order = np.argsort(shared, kind="stable")
        owner, shared = owner[order], shared[order]
        for s in range(0, int(shared[-1]) + 1 if len(shared) else 0, 4096):  # a block of shingles at a time
            a, b = np.searchsorted(shared, [s, s + 4096])
            who, what = owner[a:b], shared[a:b] - s
            left, right = np.zeros((len(x), 4096), np.float32), np.zeros((len(y), 4096), np.float32)
            p, q = place[who], other[who]
            left[p[p >= 0], what[p >= 0]] = 1
            right[q[q >= 0], what[q >= 0]] = 1
            common += left @ right.T
        n = np.diff(at).astype(float)
        p, q = np.nonzero(100 * common >= 75 * (n[x][:, None] + n[y][None] - common))
        p, q = x[p], y[q]
        ok = part[p] != part[q]
        p, q = p[ok], q[ok]
        return pa.table({"a": name[p], "b": name[q], "ca": part[p], "cb": part[q]})

    return _ordered(own.groupBy("node", "i", "j").applyInArrow(compare, "a long, b long, ca long, cb long"))


def full_sets(docs: DataFrame, wanted: DataFrame, k: int = 5) -> DataFrame:
    """set_id, shingles of the wanted (set_id, name, doc_id); of documents with an id, only the texts asked for are read
    into sets. Those without one are found by the name of their set."""

    def sets(batches):
        for batch in batches:
            raw, offsets = buffers(batch.column("text"))
            for a, b in chunks(offsets):
                value, at = shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                asked = batch.column("name").slice(a, b - a)
                name = _names(value, at)[1]
                own = pa.RecordBatch.from_arrays([batch.column("set_id").slice(a, b - a), pa.array(name), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(value.view(np.int64)))], ["set_id", "name", "shingles"])
                keep = asked.is_null().to_numpy(zero_copy_only=False) | (name == asked.fill_null(0).to_numpy())
                yield own.filter(pa.array(keep))  # another text of the same doc_id is not asked for

    kind = "set_id long, name long, shingles array<bigint>"
    found = docs.select("doc_id", "text").join(wanted.select("set_id", "name", "doc_id"), "doc_id").select("set_id", "name", "text").mapInArrow(tidy(sets), kind)
    none = F.lit(None).cast("long")
    nameless = docs.filter("doc_id IS NULL").select(none.alias("set_id"), none.alias("name"), "text").mapInArrow(tidy(sets), kind)
    nameless = nameless.drop("set_id").join(wanted.filter("doc_id IS NULL").select("set_id", "name"), "name").select("set_id", "name", "shingles")
    return found.union(nameless).dropDuplicates(["set_id"]).drop("name")


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b and what else they carry) whose full sets have 100 * intersection >= 75 * union."""
    x = sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("xs"))
    y = sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("ys"))
    both = pairs.join(x, "a").join(y, "b").withColumn("i", F.size(F.array_intersect("xs", "ys")))
    return both.filter("100 * i >= 75 * (size(xs) + size(ys) - i)").select(*pairs.columns)


def _joined(label: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """id, component after links (a, b, ca, cb) between components; ids that no link has named are left out."""
    if links.isEmpty():
        return label
    new = components(links.selectExpr("ca AS a", "cb AS b"))
    if label is None:
        return stage(new, "found")
    ends = links.selectExpr("ca AS id", "ca AS component").union(links.selectExpr("cb", "cb"))
    moved = stage(new.selectExpr("id AS old", "component AS new"), "joined")
    after = label.union(ends).distinct().join(moved, F.col("component") == F.col("old"), "left").select("id", F.coalesce("new", "component").alias("component"))
    after = stage(after.distinct(), "found")
    discard(label, moved)
    return after


def _classes(signed: DataFrame) -> DataFrame:
    """set_id, name, doc_id (the smallest), n, sketch, tokens of the different sets."""
    found = signed.filter("set_id IS NOT NULL").groupBy("set_id").agg(
        F.min("doc_id").alias("doc_id"), F.min("name").alias("name"), F.max("name").alias("_other"),
        F.min_by(F.struct(F.col("n_shingles").alias("n"), "sketch", "tokens"), F.coalesce("doc_id", F.lit((1 << 63) - 1))).alias("s"),
    )
    return stage(found.select("set_id", "name", "_other", "doc_id", "s.*"), "classes")


def near_duplicates(docs: DataFrame, k: int = 5, trees: int = TREES, small: int = SMALL, levels: int = LEVELS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    Null and empty texts, and texts of white space, have an empty set and are linked with nothing. Rows with equal
    texts are copies of one set. A null doc_id is never a component's smallest id unless all its ids are null; only
    then are such rows kept. Other columns are left aside. An empty table has no rows.
    """
    found = groups(docs, k, trees, small, levels)
    return found.select("doc_id", "n_shingles", "component_id", F.expr("doc_id <=> component_id").alias("kept"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs (doc_id, text and others) without near-duplicates: one row of each group, that of the smallest
    doc_id (null last; of several texts with it, one by a hash; of repeated rows, any). Rows without words all stay."""
    found = groups(docs, **options)
    last = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    first = found.filter("n_shingles > 0").groupBy("component").agg(F.min_by(F.struct("doc_id", "text_key"), F.struct(last, "text_key")).alias("f"))
    kept = stage(first.select("f.doc_id", "f.text_key").union(found.filter("n_shingles = 0").select("doc_id", "text_key").distinct()), "kept")
    again = found.filter("n_shingles > 0").groupBy("doc_id", "text_key").count().filter("count > 1").select("doc_id", "text_key")
    again = stage(again, "again")
    columns = [F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_x")]
    match = lambda t: F.col("_d").eqNullSafe(t["doc_id"]) & (F.col("_x") == t["text_key"])
    rows = docs.select(*columns).join(kept, F.col("_d").eqNullSafe(kept["doc_id"]) & (F.col("_x") == kept["text_key"]), "left_semi")
    if again.isEmpty():
        return rows.select("row.*")
    once = rows.join(again, match(again), "left_semi").groupBy("_d", "_x").agg(F.first("row").alias("row")).select("row.*")
    return rows.join(again, match(again), "left_anti").select("row.*").union(once)


def groups(docs: DataFrame, k: int = 5, trees: int = TREES, small: int = SMALL, levels: int = LEVELS) -> DataFrame:
    """doc_id, text_key, n_shingles, component (a name of its own; null without words) and component_id of every row."""
    signed = stage(signatures(docs, k), "signatures")
    classes = _classes(signed)
    clash = classes.filter("name <> _other").select("set_id")
    if not clash.isEmpty():  # different sets of one 64-bit name: both names tell them apart
        both = F.when(F.col("_clash"), F.xxhash64("set_id", "name")).otherwise(F.col("set_id"))
        apart = signed.join(clash.withColumn("_clash", F.lit(True)), "set_id", "left").withColumn("set_id", both).drop("_clash")
        signed = stage(apart, "signatures")
        classes = _classes(signed)
    label = sets = None
    rows, aside = roots(classes, trees), []
    for level in range(levels):
        met = stage(_mixed(rows, label), "met")
        if level:
            discard(rows)
        pairs = stage(_pairs(met, small, "p, q" if label is None else "p"), "pairs")
        crowd = met.filter(F.col("members") > small).drop("component", "members", "p", "q")
        if sets is None:  # whoever may be compared later is in a pair or a crowd of the first level
            wanted = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).union(crowd.select("set_id")).distinct()
            sets = stage(full_sets(docs, classes.join(wanted, "set_id").select("set_id", "name", "doc_id"), k), "sets")
        links = stage(confirm(pairs, sets), "links")
        label = _joined(label, links)
        crowd = stage(_several(crowd, label, m=_pivot(F.lit(3))), "crowd")  # nodes of much the same sets have one m
        discard(met, pairs, links)
        tight = stage(_tight(crowd), "tight")
        aside.append(stage(crowd.join(tight, "node").select(F.col("around").alias("node"), "set_id", "n"), "aside"))
        loose = crowd.join(tight, "node", "left_anti").drop("component", "m")
        last = level + 1 == levels or loose.isEmpty()
        if last:
            aside.append(stage(loose.select("node", "set_id", "n"), "aside"))
        else:  # staged, as it is read twice
            rows = loose if "tokens" in loose.columns else loose.join(classes.select("set_id", "tokens"), "set_id")
            rows = stage(_branch(rows), "branched")
        discard(crowd, tight)
        if last:
            break
    if aside:
        left = stage(_several(reduce(DataFrame.union, aside).distinct(), label), "left")
        discard(*aside)
        if not left.isEmpty():
            label = _joined(label, stage(_across(left, sets), "links"))
    # a class's component is named by its smallest document
    label = _named(classes.select("set_id", "doc_id"), label)
    least = label.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    label = label.join(least, "component").select("set_id", "component", "component_id")
    out = signed.select("doc_id", "text_key", "n_shingles", "set_id").join(label, "set_id", "left")
    return out.select("doc_id", "text_key", "n_shingles", "component", F.coalesce("component_id", "doc_id").alias("component_id"))
