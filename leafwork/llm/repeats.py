"""Removal of repeated byte strings with suffix arrays.

Every byte covered by a `length`-byte string that also starts earlier (smaller doc_id, or the same document further
left) goes; matches never cross documents and are judged on the input. Equal strings hold equal bytes at the same
place, so each string is given to one anchor, the leftmost of the least-hashed GRAM-byte grams in it, chosen by content
alone: two equal strings have the same gram at the same offset. The strings of one anchor form a slice.

1. Equal texts: all but the first document goes whole.
2. Anchors whose gram occurs once are out; equal slices of one gram are all repeated but the first.
3. What differs is decided by suffix arrays: the first slices of a gram, cut into 8-byte blocks counted from the anchor,
   are sorted in buckets of grams by the linear grouping of suffixes.py; a run of suffixes that share the blocks of a
   string and the bytes at its ends is a set of equal strings, and all but the first are repeated.

A gram with more than HOT first slices would make too large a bucket: its strings are named by 128 bits each, and the
first of each name is found by a grouping with partial results, so no string meets all its copies in a task.
The suffix arrays run over blocks of such slices alone: in Python, bytes of the whole corpus would take far longer.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leafwork.llm.common import discard, small_batches, stage
from leafwork.llm.suffixes import suffix_array
from leafwork.llm.textbytes import BASE, BYTE, U, buffers, chunks, mix, powers, tidy

GRAM = 16
BLOCK = 8
BUCKET = 1500  # slices in a bucket, about
HOT = 8192
_POSITION = 24  # bits of a place within a chunk; the rest of a key are a gram's hash


def _sliding(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row."""
    m = 1
    while m * 2 <= width:
        x = np.minimum(x[:-m], x[m:])
        m *= 2
    return np.minimum(x[: len(x) - (width - m)], x[width - m :]) if width > m else x


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, first string, last string, gram hash, slice hash) of the anchors of rows; places in raw, strings by their start."""
    empty = np.zeros(0, np.int64)
    n = len(raw)
    if n < length:
        return empty, empty, empty, empty.astype(U), empty.astype(U)
    with np.errstate(over="ignore"):
        h, m, p = BYTE[raw], 1, int(BASE)
        while m < GRAM:
            h = h[:-m] * U(p) + h[m:]
            p, m = p * p % (1 << 64), m * 2
        h = mix(h)
    key = (h >> U(_POSITION)) << U(_POSITION) | np.arange(len(h), dtype=U)
    least = _sliding(key, length - GRAM + 1)
    chosen = (least & U((1 << _POSITION) - 1)).astype(np.int64)
    inside = np.zeros(n + 1, np.int64)
    np.add.at(inside, offsets[1:-1], 1)
    row = np.cumsum(inside)[:n]  # a string is valid where its first and last byte are of one row
    chosen[row[: n - length + 1] != row[length - 1 :]] = -1
    turn = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    last = np.append(turn[1:], len(chosen)) - 1
    ok = chosen[turn] >= 0
    first, last = turn[ok], last[ok]
    place = chosen[first]
    up, down = powers(n + 1)
    with np.errstate(over="ignore"):
        run = np.concatenate([np.zeros(1, U), np.cumsum(BYTE[raw] * up[:n], dtype=U)])
        content = mix((run[last + length] - run[first]) * down[first] ^ ((place - first).astype(U) << U(32) | (last - first).astype(U)))
    return place, first, last, h[place], content


def _marked(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, key and the anchors of every text: grams, contents and meta (place, strings left of it: most, least) as arrays."""

    def run(batches):
        for batch in batches:
            raw, offsets = buffers(batch.column("text"))
            for a, b in chunks(offsets):
                own, at = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                parts = []
                # a text beyond a chunk's places is taken in parts that overlap by what a string needs
                step = (1 << _POSITION) - length
                for s in range(0, max(1, len(own)), step):
                    e = min(len(own), s + step + length - 1)
                    cut = np.unique(np.clip(at, s, e)) - s
                    place, first, last, gram, content = anchors(own[s:e], cut if len(cut) > 1 else np.array([0, e - s]), length)
                    parts.append((place + s, first + s, last + s, gram, content))
                place, first, last, gram, content = (np.concatenate(x) for x in zip(*parts))
                row = np.searchsorted(at, first, side="right") - 1
                ends = pa.array(np.searchsorted(row, np.arange(b - a + 1)), pa.int32())
                meta = (place - at[row]) << 16 | (place - first) << 8 | (place - last)
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.view(np.int64))) for x in (gram, content, meta)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("key").slice(a, b - a), *lists], ["doc_id", "key", "gram", "content", "meta"])

    return docs.mapInArrow(tidy(run), "doc_id long, key long, gram array<bigint>, content array<bigint>, meta array<bigint>")


def repeated_in_bucket(doc: np.ndarray, place: np.ndarray, most: np.ndarray, least: np.ndarray, slices: list[bytes], length: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slice, start, end) of what is covered by strings that also start earlier in the bucket, by one suffix array.

    Slice i holds the strings that start `most` to `least` bytes left of its anchor at `place` of document doc[i].
    """
    whole = (length - (BLOCK - 1)) // BLOCK  # blocks that lie in every string, wherever it starts
    lead = most // BLOCK  # whole blocks left of the anchor
    count = lead + (length - least) // BLOCK
    data = np.frombuffer(b"".join(slices) + b"\0" * BLOCK, np.uint8)
    base = np.concatenate([[0], np.cumsum([len(s) for s in slices])])[:-1]
    begin = base + most - lead * BLOCK
    total = count + 1
    starts = np.cumsum(total) - total
    owner = np.repeat(np.arange(len(slices)), total)
    k = np.arange(total.sum()) - starts[owner]
    real = k < count[owner]
    at = np.where(real, begin[owner] + k * BLOCK, 0)
    value = np.zeros(len(at), U)
    for b in range(BLOCK):
        value |= data[at + b].astype(U) << U(8 * b)
    names = np.unique(value[real], return_inverse=True)[1] + 1
    text = np.zeros(len(at), np.int64)  # 0 ends a slice
    text[real] = names
    order = suffix_array(text)
    full = np.zeros(len(at), bool)
    full[:] = k + whole <= count[owner]
    order = order[full[order]]
    if not len(order):
        none = np.zeros(0, np.int64)
        return none, none, none
    same = np.ones(len(order), bool)
    same[0] = False
    for b in range(whole):
        same[1:] &= text[order[1:] + b] == text[order[:-1] + b]
    run = np.zeros(len(at), np.int64)
    run[order] = np.cumsum(~same)
    # the strings: start is counted from the anchor, so -most .. -least
    strings = most - least + 1
    own = np.repeat(np.arange(len(slices)), strings)
    start = np.arange(strings.sum()) - (np.cumsum(strings) - strings)[own] - most[own]
    block = -(-start // BLOCK)
    left = block * BLOCK - start
    group = run[starts[own] + block + lead[own]]
    origin = base[own] + most[own]
    ends = np.zeros((2, len(own)), U)  # the bytes beside the whole blocks, left then right
    spare = length - whole * BLOCK
    for b in range(spare):
        where = origin + start + b + np.where(b >= left, whole * BLOCK, 0)
        ends[b // 8] |= data[where].astype(U) << U(8 * (b % 8))
    first = place[own] + start
    by = np.lexsort((first, doc[own], ends[1], ends[0], left, group))
    equal = np.zeros(len(by), bool)
    for x in (group, left, ends[0], ends[1]):
        d = x[by]
        if x is group:
            equal[1:] = d[1:] == d[:-1]
        else:
            equal[1:] &= d[1:] == d[:-1]
    # later than the first of its set: another document, or another start
    lead_at = np.maximum.accumulate(np.where(equal, 0, np.arange(len(by))))
    later = equal & ((doc[own[by]] != doc[own[by[lead_at]]]) | (first[by] != first[by[lead_at]]))
    hit = np.zeros(len(by), bool)
    hit[by] = later
    edge = np.flatnonzero(hit & ~(np.concatenate([[False], hit[:-1]]) & np.concatenate([[False], own[1:] == own[:-1]])))
    stop = np.flatnonzero(hit & ~(np.concatenate([hit[1:], [False]]) & np.concatenate([own[1:] == own[:-1], [False]])))
    return own[edge], first[edge], first[stop] + length


def covered(docs: DataFrame, length: int = 100, hot: int = HOT) -> DataFrame:
    """doc_id, key, spans (array of start, end in bytes) of docs (doc_id, key, text): what strings that start earlier cover."""
    spark = docs.sparkSession
    least_id = F.coalesce("doc_id", F.lit(-(1 << 63)))
    # equal texts by their whole SHA-256: no two different ones share it; key, a part of another hash, tells a document's rows apart
    digest = F.unhex(F.sha2("text", 256))
    names = docs.select("doc_id", "key", F.octet_length("text").alias("n"), digest.alias("digest")).distinct()
    firsts = docs.select("doc_id", digest.alias("digest")).groupBy("digest").agg(F.min(least_id).alias("first"))
    named = stage(names.join(firsts, "digest").withColumn("copy", least_id > F.col("first")).drop("digest"), "names")
    whole = named.filter(f"copy AND n >= {length}").select("doc_id", "key", F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col("n").cast("long").alias("hi"))).alias("spans"))
    # the first document of every text that has others, or is long enough to hold a string
    single = named.filter(f"NOT copy AND n >= {length}").select(F.col("key").alias("_k"), F.col("doc_id").alias("_d"))
    mine = lambda d, k: F.col("key").eqNullSafe(F.col(k)) & F.col("doc_id").eqNullSafe(F.col(d))
    texts = docs.join(single, mine("_d", "_k"), "left_semi")
    marked = stage(_marked(texts, length), "anchors")
    each = marked.select("doc_id", "key", F.explode(F.arrays_zip("gram", "content", "meta")).alias("a")).select("doc_id", "key", "a.*")
    grams = each.groupBy("gram").agg(F.count("*").alias("n"), F.min("content").alias("x"), F.max("content").alias("y")).filter("n > 1")
    grams = stage(grams.select("gram", F.expr("x <> y").alias("several")), "grams")
    met = stage(each.join(grams, "gram"), "met")
    discard(marked)
    spot = F.struct(least_id.alias("d"), F.col("meta").alias("m"), F.col("key").alias("k"))  # the place leads in meta
    first = stage(met.groupBy("gram", "content", "several").agg(F.min(spot).alias("first")), "first")
    later = met.join(first.select("gram", "content", "first"), ["gram", "content"])
    later = later.filter((least_id != F.col("first.d")) | (F.shiftright("meta", 16) != F.shiftright("first.m", 16)))
    place = F.shiftright("meta", 16)
    equal = stage(later.select("doc_id", "key", (place - F.expr("(meta >> 8) & 255")).alias("lo"), (place - F.expr("meta & 255") + length).alias("hi")), "equal")
    discard(met)
    # the first slices of grams that have several, cut from their texts
    some = first.filter("several").select("gram", F.col("first.d").alias("_d"), F.col("first.k").alias("_k"), F.col("first.m").alias("meta"))
    many = stage(some.groupBy("gram").count().filter(F.col("count") > hot).select("gram"), "many")
    total = first.filter("several").count()
    buckets = max(1, -(-total // BUCKET))

    def asked(chosen: DataFrame) -> DataFrame:
        """The texts that hold the chosen slices, with their places; a text's list is bounded by the text."""
        wanted = chosen.groupBy("_d", "_k").agg(F.collect_list(F.struct("gram", "meta")).alias("wanted"))
        return docs.withColumn("_o", least_id).join(wanted, (F.col("key") == F.col("_k")) & (F.col("_o") == F.col("_d"))).select("doc_id", "key", "text", "wanted")

    def cut(batches):
        for batch in batches:
            out = [[], [], [], [], [], [], []]
            for doc, key, text, items in zip(batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
                data = text.encode()
                for item in items:
                    place, most, least = item["meta"] >> 16, item["meta"] >> 8 & 255, item["meta"] & 255
                    for k, v in enumerate((item["gram"] % buckets, doc, key, place, most, least, data[place - most : place - least + length])):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in out[:6]), pa.array(out[6], pa.binary())], ["bucket", "doc_id", "key", "place", "most", "least", "piece"])

    def name(batches):
        for batch in batches:
            rows, names, starts = [], [], []
            texts = batch.column("text").to_pylist()
            for i, items in enumerate(batch.column("wanted").to_pylist()):
                data = texts[i].encode()
                for item in items:
                    place = item["meta"] >> 16
                    for lo in range(place - (item["meta"] >> 8 & 255), place - (item["meta"] & 255) + 1):
                        rows.append(i), starts.append(lo), names.append(hashlib.blake2b(data[lo : lo + length], digest_size=16).digest())
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("key").take(take), pa.array(starts, pa.int64()), pa.array(names, pa.binary())], ["doc_id", "key", "lo", "name"])

    def sort(t: pa.Table) -> pa.Table:
        doc = t.column("doc_id").fill_null(-(1 << 63)).to_numpy()
        which, lo, hi = repeated_in_bucket(doc, *(t.column(c).to_numpy() for c in ("place", "most", "least")), t.column("piece").to_pylist(), length)
        take = pa.array(which)
        return pa.table({"doc_id": t.column("doc_id").take(take), "key": t.column("key").take(take), "lo": lo, "hi": hi})

    slices = asked(some.join(many, "gram", "left_anti")).mapInArrow(tidy(cut), "bucket long, doc_id long, key long, place long, most long, least long, piece binary")
    differing = slices.groupBy("bucket").applyInArrow(sort, "doc_id long, key long, lo long, hi long")
    differing = stage(differing, "differing")
    if not many.isEmpty():
        strings = stage(asked(some.join(many, "gram", "left_semi")).mapInArrow(tidy(name), "doc_id long, key long, lo long, name binary"), "strings")
        leads = strings.groupBy("name").agg(F.min(F.struct(least_id.alias("d"), "lo")).alias("lead"))
        again = strings.join(leads, "name").filter((least_id != F.col("lead.d")) | (F.col("lo") != F.col("lead.lo")))
        differing = stage(differing.union(again.select("doc_id", "key", "lo", (F.col("lo") + length).alias("hi"))), "differing")
    discard(first)
    spans = equal.union(differing)
    parts = spans.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"))  # bounded by the text
    return parts.unionByName(whole)


def _cut(text: str | None, spans: list | None) -> tuple[bytes, int, int, int]:
    """The bytes of text without spans (sorted; they may overlap), its bytes, those removed, and the runs of them."""
    data = (text or "").encode()
    parts, upto, removed, n = [], 0, 0, 0
    for s in spans or []:
        lo, hi = s["lo"], s["hi"]
        if lo > upto or (n == 0):
            parts.append(data[upto:lo])
            n += 1
            removed += hi - lo
            upto = hi
        elif hi > upto:
            removed += hi - upto
            upto = hi
    parts.append(data[upto:])
    return b"".join(parts), len(data), removed, n


def _with_spans(docs: DataFrame, length: int, hot: int) -> DataFrame:
    """Adds spans (null where nothing repeats) to docs."""
    small_batches(docs.sparkSession)
    if length < 32 or length > 255:
        raise ValueError("length from 32 to 255 bytes")
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumn("_key", F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"))
    found = covered(keyed.select(F.col("doc_id").cast("long"), F.col("_key").alias("key"), text.alias("text")), length, hot)
    return keyed.join(found.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "spans"), (F.col("_key") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left").drop("_d", "_k", "_key")


def remove_repeats(docs: DataFrame, length: int = 100, hot: int = HOT) -> DataFrame:
    """Adds kept (the remaining bytes), n_bytes, n_removed, n_spans and kept_sha256 to docs (doc_id, text).

    A null text is empty; texts of fewer than `length` bytes stay as they are. Rows that share doc_id and text are one
    document twice: both are judged alike. A null doc_id comes before all others. Columns of the new names in docs
    are replaced.
    """
    new = ["kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    base = docs.drop(*new, "_key")
    joined = _with_spans(base, length, hot)

    def apply(batches):
        for batch in batches:
            out = {n: [] for n in new}
            for text, own in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                kept, *figures = _cut(text, own)
                for name, v in zip(new, (kept, *figures, hashlib.sha256(kept).hexdigest())):
                    out[name].append(v)
            keep = [c for c in batch.schema.names if c != "spans"]
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(out[n], k) for n, k in zip(new, kinds))], [*keep, *new])

    kind = ", ".join(f"`{n}` {t}" for n, t in base.dtypes)
    return joined.mapInArrow(tidy(apply), f"{kind}, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """docs with what repeats taken out of text (and n_chars, if there); a character cut in the middle goes.

    A null text becomes an empty one. Other columns stay, whatever their names. Cut and decoded in one Python pass: a
    second one behind it would take a second worker for every running task.
    """
    names = docs.columns
    others = [c for c in names if c not in ("doc_id", "text", "n_chars")]
    packed = docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *others).alias("row"))
    joined = _with_spans(packed, length, HOT).select("doc_id", "text", "row", "spans")

    def decode(batches):
        for batch in batches:
            pairs = zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())
            texts = [_cut(text, own)[0].decode(errors="ignore") for text, own in pairs]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["doc_id", "row", "text", "n_chars"])

    kinds = dict(joined.dtypes)
    out = joined.mapInArrow(tidy(decode), f"doc_id {kinds['doc_id']}, row {kinds['row']}, text string, n_chars long")
    made = {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in names:
        made["n_chars"] = F.col("n_chars").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*(made.get(c, F.col("row")[c].alias(c)) for c in names))
