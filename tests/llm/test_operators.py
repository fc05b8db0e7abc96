"""The corpus operators against brute force, exact round trips and held-out accuracy, with odd rows in every table."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from leafwork.llm import bitpack, chosenpath, factorization, forest, mixing, packing, queries, repeats, routing, rules, textbytes, urls
from leafwork.llm.common import components, prefix, stage
from leafwork.llm.encoder import Encoder, _classes, encoder
from leafwork.llm.queries import TOKENIZER, URL_RULES
from leafwork.llm.suffixes import suffix_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LIBRARY = {}
LONG = "palavra longa de teste " * 6000


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank and very long texts, repeated rows, a null id, and columns whose names the operators use."""
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, LONG), (5, "um dois"), (5, "um dois"), (6, "um  dois"), (None, "sem número"), (7, "<|endoftext|> é ação 日本 "), (8, "Um Dois")]
    data = [(i, t, f"s{(i or 0) % 2}" if i != 3 else None, 0.5, 1, True, "x") for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, source string, score double, size int, kept boolean, length string")


def test_prefix_and_components(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("g"), F.shiftleft(F.col("id") * 7919 % 1009, 50).alias("_h"))
    got = prefix(df, ["g"], ["_h", "id"], F.col("id"), "before", per_bucket=16).collect()
    for g in range(3):
        own = sorted((r["_h"], r["id"], r["before"]) for r in got if r["g"] == g)
        assert [b for *_, b in own] == [0, *itertools.accumulate(i for _, i, _ in own)][:-1]
    edges = [(a, a + 1) for a in range(0, 40)] + [(100, b) for b in range(101, 150)]
    found = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == (0 if i < 100 else 100) for i in found) and len(found) == 91
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_array(symbols):
    assert suffix_array(np.array(symbols, np.int64)).tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])


@pytest.mark.parametrize("bits", [1, 7, 15, 16, 17, 32])
def test_pack_bits(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000).astype(np.uint32)
    assert (bitpack.unpack(bitpack.pack(ids, bits), bits, 1000) == ids).all()
    assert len(bitpack.pack(ids, bits)) == 1024 * bits // 8


def test_packed_files(spark, odd, tmp_path):
    tok = Tokenizer.from_file(TOKENIZER)
    got = bitpack.round_trip(odd, TOKENIZER, added=True).orderBy("start").collect()
    start = 0
    for r, (i, t) in zip(got, sorted(((r.doc_id, r.text) for r in odd.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), strict=True):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert bitpack.round_trip(odd.limit(0), TOKENIZER).collect() == []
    files = bitpack.write(odd, f"file://{tmp_path}/ids", TOKENIZER)
    reader = bitpack.Reader(next(f["path"] for f in files if f["docs"]))
    assert reader.ids(0)[-1] == 0
    with pytest.raises(ValueError):
        bitpack.Writer(f"{tmp_path}/x.bin", 3).add([1], np.array([9], np.uint32), np.array([1]))


def test_encoder_with_nul():
    """A NUL at a part's start, middle and end is text like any other."""
    tok = Tokenizer.from_file(TOKENIZER)
    texts = ["x \0abc", "\0abc x", "x abc", "abc \0", "\0", " \0", "x  \0abc", "\0  \0abc abc", "a\0b \0\0abc"]
    ids, ends = Encoder(TOKENIZER).encode(texts)
    for i, t in enumerate(texts):
        assert ids[ends[i] : ends[i + 1]].tolist() == tok.encode(t, add_special_tokens=False).ids, t


_PIECES = st.sampled_from([*"abst're vldm \n\t\r\"!.12é日ñ\x85\u180e\x1c\x1f\0\u00a0\u2028²½𝑓", "'re", "'ll", " 's", "  ", "\u0558", "\u088f", "<|endoftext|>", "<|endoftext", "|>"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.lists(_PIECES, max_size=12).map("".join), st.text(max_size=12), st.none()), max_size=6), st.booleans())
def test_encoder_is_the_library(texts, added):
    """Any texts have the ids of the library's plain call, and of its call with special strings taken as text."""
    tok = _LIBRARY.setdefault(added, Tokenizer.from_file(TOKENIZER))
    tok.encode_special_tokens = not added
    ids, ends = encoder(TOKENIZER, added).encode(texts)
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(ends)] == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_encoder_knows_the_librarys_classes():
    """Letters, numbers, white space and others are told apart as by the library; unassigned code points go to it."""
    split, kind = Tokenizer.from_file(TOKENIZER).pre_tokenizer, _classes()
    for c in [*range(0x3100), *range(0x3100, 0x110000, 37)]:
        if not 0xD800 <= c < 0xE000 and kind[c] != 4:
            starts = {a for _, (a, _) in split.pre_tokenize_str(f"a{chr(c)}1{chr(c)}!{chr(c)} ")}
            assert kind[c] == (0 if 1 not in starts else 1 if 3 not in starts else 2 if 5 not in starts else 3), hex(c)


def test_added_tokens_in_texts(spark, odd, tmp_path):
    """The queries' ids are those of the unmodified library, with <|endoftext|> in a text as its own id."""
    tok = Tokenizer.from_file(TOKENIZER)
    more = [(20, "a <|endoftext|> b"), (21, "<|endoftext|><|endoftext|>"), (22, "x<|endoftext|> \n"), (23, "<|endoftext"), (24, "c d")]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    docs.withColumn("source", F.lit("s")).write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted((str(r.doc_id), tok.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect())
    assert ("20", [64, 220, 50256, 275]) in want
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    got = queries.op4_bit_packed_ids(spark, f"file://{tmp_path}").collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((i, len(ids) + 1, crc([*ids, 0])) for i, ids in want)
    got = [r for r in queries.op3_best_fit_packing(spark, f"file://{tmp_path}").collect() if r.doc_id != 4]
    assert sorted((str(r.doc_id), r.length, r.ids_crc32) for r in got) == sorted((i, len(ids) + 1, crc([*ids, 2])) for i, ids in want if i != "4")
    docs = docs.filter("doc_id >= 20")
    packed = corpus_pipeline.packed(spark, docs, "").collect()
    assert sorted((r.doc_id, r.ids_crc32) for r in packed) == [(int(i), crc([*ids, 2])) for i, ids in want if i >= "20" and len(i) == 2]


def test_packing(spark, odd):
    tok = Tokenizer.from_file(TOKENIZER)
    got = packing.pack(odd, TOKENIZER, full=64, added=True).orderBy("sequence_id", "offset").collect()
    by = {}
    for r in got:
        assert r.offset == by.get(r.sequence_id, 0) and zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 64
    long = sorted((r for r in got if r.doc_id == 4), key=lambda r: r.piece)
    whole = np.concatenate([np.frombuffer(r.ids, "<u4") for r in long]).tolist()
    assert whole == [*tok.encode(LONG, add_special_tokens=False).ids, 2]
    assert all(r.length == 64 for r in long[1:]) and [r.start for r in long] == [0, *np.cumsum([r.length for r in long])[:-1].tolist()]
    assert sum(r.length for r in got if r.doc_id in (1, 2)) == 2
    assert packing.pack(odd.limit(0), TOKENIZER).collect() == []


def test_packing_in_many_parts(spark, monkeypatch):
    """The counts lie in few files however many partitions a shuffle has, and the driver gives the plan's memory back."""
    docs = spark.createDataFrame([(i, "bom dia " * (i % 300)) for i in range(600)], "doc_id long, text string").repartition(7)
    staged, given = {}, []

    def noted(df, name):
        staged[name] = stage(df, name)
        return staged[name]

    monkeypatch.setattr(packing, "stage", noted)
    monkeypatch.setattr(packing, "give_back", lambda: given.append(1))
    keep = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keep}
    for k, v in keep.items():
        spark.conf.set(k, v)
    try:
        got = packing.pack(docs, TOKENIZER, end_id=2).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(staged["lengths"].inputFiles()) <= packing.FILES and given
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 1024 and len({(r.doc_id, r.piece) for r in got}) == len(got) and {r.doc_id for r in got} == set(range(600))


def test_packing_plan():
    h = np.bincount(np.minimum(1024, np.random.default_rng(1).lognormal(5.8, 1, 20_000).astype(int) + 1), minlength=1025)
    plan = packing.plan(h)
    used = np.zeros(1025, int)
    for own, times in plan:
        assert sum(own) <= 1024
        for v in own:
            used[v] += times
    total = (h * np.arange(1025)).sum()
    assert (used == h).all() and sum(t for _, t in plan) <= 1.003 * -(-total // 1024)
    assert packing.plan(np.zeros(1025, int)) == []


def _near_rows():
    rng, rows = random.Random(3), []
    vocabulary = [f"w{i}" for i in range(2000)]
    for _ in range(8):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 160))]
        for _ in range(rng.choice([1, 2, 5, 40])):
            t = list(base)
            for _ in range(rng.randint(0, 6)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            rows.append((len(rows) + 100, " ".join(t)))
    return rows + [(len(rows) + 100, rows[0][1].upper())]


@pytest.mark.parametrize("options", [{}, {"small": 4, "levels": 1}, {"small": 4, "levels": 2}])
def test_near_duplicates(spark, odd, options):
    df = odd.select("doc_id", "text", "kept").unionByName(spark.createDataFrame(_near_rows(), "doc_id long, text string").withColumn("kept", F.lit(False)))
    rows = [(r.doc_id, r.text) for r in df.collect()]
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    label = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        n = len(sets[i] & sets[j])
        if n and 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
    least = {}
    for (i, _), x in zip(rows, label):
        if i is not None:
            least[x] = min(least.get(x, i), i)
    want = sorted((str(i), len(s), str(least.get(x))) for (i, _), s, x in zip(rows, sets, label))
    got = chosenpath.near_duplicates(df, **options).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def _crowd(pairs=120, seed=5, words=200):
    """Sets that all share a base without being linked, and one partner of each at a similarity just above 0.75."""
    rng, out = random.Random(seed), []
    base = [f"b{i}" for i in range(words)]

    def similarity(a, b):
        a, b = ({tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in (a, b))
        return len(a & b) / len(a | b)

    for p in range(pairs):
        own = list(base)
        while similarity(own, base) > 0.62:
            own[rng.randrange(words)] = f"o{p}_{rng.random()}"
        twin = list(own)
        while True:
            after = list(twin)
            after[rng.randrange(words)] = f"t{p}_{rng.random()}"
            if similarity(own, after) < 0.75:
                break
            twin = after
        out += [(2 * p, " ".join(own)), (2 * p + 1, " ".join(twin))]
    return out


def test_near_duplicates_in_a_crowded_node(spark):
    """Pairs at the threshold stay together where branching stops: nothing is lost after the first level."""
    df = spark.createDataFrame(_crowd(), "doc_id long, text string")
    got = chosenpath.near_duplicates(df, trees=6, small=4, levels=1).collect()
    assert [r.doc_id for r in got if r.component_id != r.doc_id - r.doc_id % 2] == []


def test_near_copies_do_not_branch(spark, monkeypatch):
    """A large group of near copies, some of them linked with nothing, is compared exactly instead of being dealt to
    ever more nodes of much the same sets; all that is compared at the end are the sets of a few crowds."""
    rng, words, made, left = random.Random(8), 300, [], []
    base, rows = [f"b{i}" for i in range(words)], []
    for d in range(120):  # an edit replaces 5 shingles: 4 of them leave a copy that links, 17 one that is alone
        own = list(base)
        for k in range(4 if d % 3 else 17):
            own[(2 * d + 17 * k) % words] = f"o{d}_{rng.random()}"
        rows.append((d, " ".join(own)))
    branch, across = chosenpath._branch, chosenpath._across
    monkeypatch.setattr(chosenpath, "_branch", lambda rows: made.append(branch(rows).count()) or branch(rows))
    monkeypatch.setattr(chosenpath, "_across", lambda crowd, *rest: left.append(crowd.count()) or across(crowd, *rest))
    got = chosenpath.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = [{tuple(w[k : k + 5]) for k in range(words - 4)} for w in (t.split() for _, t in rows)]
    label = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        n = len(sets[i] & sets[j])
        if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
    assert len(set(label)) > 10
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(label))
    assert sum(made) <= 2 * len(rows) and sum(left) <= 6 * len(rows)


def test_near_duplicates_without_ids(spark):
    """A row without an id links its neighbours, and goes where its group has a row with an id."""
    text = lambda a, b: " ".join(f"w{i}" for i in range(a, b))  # noqa: E731  0.82 to the middle, 0.68 from end to end
    rows = [(1, text(0, 100)), (None, text(10, 110)), (None, text(10, 110)), (2, text(20, 120)), (None, "só um"), (None, None)]
    got = chosenpath.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [("1", "1", True), ("2", "1", False), ("None", "1", False), ("None", "1", False), ("None", "None", True), ("None", "None", True)]


def test_near_duplicates_of_nothing(spark, odd):
    assert chosenpath.near_duplicates(odd.limit(0)).collect() == []


@pytest.mark.parametrize("hot", [repeats.HOT, 2])
def test_repeats(spark, odd, hot):
    rng, rows = random.Random(4), [(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None and r.doc_id != 4]
    for d in range(100, 180):
        parts = []
        for _ in range(rng.randint(0, 5)):
            t = rng.choice(rows)[1] or "semente "
            i = rng.randint(0, len(t))
            parts.append(rng.choice([t[i : i + 300], "ab" * rng.randint(1, 90), "".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 250)))]))
        rows.append((d, "".join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_bytes", F.lit("x"))
    first, want = {}, {}
    for d, t in sorted(set(rows), key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if first.setdefault(b[i : i + 100], (d, i)) != (d, i):
                gone[i : i + 100] = b"\1" * 100
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[d] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest(), kept)
    got = repeats.remove_repeats(df, hot=hot).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) == want[r.doc_id], r.doc_id
    assert repeats.remove_repeats(df.limit(0)).collect() == []
    assert repeats.without_repeats(df.limit(5)).columns == df.columns


def test_repeats_are_cut_in_one_python_pass(spark):
    """A second Python step behind the first takes a second worker for every running task, which then live on."""
    same = "".join(random.Random(5).choices("abcdé", k=300))
    df = spark.createDataFrame([(1, same, "x", 1), (2, "début " + same + " fin", None, 2), (3, None, "y", 3)], "doc_id long, text string, spans string, n_chars int")
    out = repeats.without_repeats(df)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = {r.doc_id: tuple(r) for r in out.collect()}
    assert got == {1: (1, same, "x", 300), 2: (2, "début  fin", None, 10), 3: (3, "", "y", 0)}


def test_memory_goes_back(spark, sf, tmp_path, monkeypatch):
    """Of workers at the end of each task, of the driver after a fit."""
    mark = tmp_path / "worker"

    def noted(batches):
        yield from batches

    kept = []
    monkeypatch.setattr(textbytes, "give_back", lambda: mark.write_text("given"))
    batch = pa.RecordBatch.from_pydict({"x": [1, 2]})
    assert list(textbytes.tidy(noted)(iter([batch, batch]))) == [batch, batch] and mark.read_text() == "given"
    monkeypatch.setattr(factorization, "give_back", lambda: kept.append("fit"))
    docs = spark.createDataFrame([(i, f"bom dia {'tolo' if i % 3 == 0 else 'amigo'}") for i in range(200)], "doc_id long, text string")
    factorization.fit(docs, docs.selectExpr("doc_id", "int(doc_id % 3 = 0) AS toxic"))
    assert kept == ["fit"]


def test_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[100:140] = x[0] + 0.02 * rng.normal(size=(40, 16)).astype(np.float32)
    x[140:150] = x[1]
    rows = [(i, v.tolist(), int(i % 2) if i < 290 else None) for i, v in enumerate(x)]
    rows += [(300, None, 1), (301, [], 1), (302, [0.0] * 16, 1), (303, [float("nan")] * 16, 1), (304, [None] * 16, 1), (305, [1.0, 2.0], 1), (306, [2.0, 4.0], 1), (307, [float("inf")] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rank", F.lit(1))
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98) & ~np.eye(300, dtype=bool)
    label = np.array([i % 2 if i < 290 else -1 - i for i in range(300)])
    near &= label[:, None] == label[None]
    got = {r.vec_id: r for r in forest.near_vectors(df).collect()}
    assert [got[i].n_links for i in range(300)] == near.sum(1).tolist()
    assert got[305].n_links == 1 and got[306].component_id == 305 and all(got[i].n_links == 0 and got[i].kept for i in (300, 301, 302, 303, 304, 307))
    reach = np.eye(300, dtype=bool) | near
    for _ in range(6):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    assert [got[i].component_id for i in range(300)] == reach.argmax(1).tolist()
    asked = df.filter("vec_id % 20 = 0")
    found = routing.search(df, asked, top=20).collect()
    score = x.astype(float) @ x.astype(float).T
    hits = 0
    for q in range(0, 300, 20):
        best = sorted((-round(score[q, i], 9), i) for i in range(300) if i != q)[:20]
        own = sorted((r.rank, r.vec_id) for r in found if r.query_id == q)
        assert [k for k, _ in own] == list(range(1, 21))
        hits += len({i for _, i in own} & {i for _, i in best})
    assert hits / 300 >= 0.9
    assert forest.near_vectors(df.limit(0)).collect() == [] and routing.search(df.limit(0), asked.limit(0)).collect() == []


def _clusters(n, dimension, clusters, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dimension)) * 0.5 + 3 * rng.normal(size=(clusters, dimension))[rng.integers(0, clusters, n)]
    return x, rng


@pytest.mark.parametrize("options", [{"leaf": 64, "sample": 1500}, {"leaf": 16, "sample": 200, "tile": 40}])
def test_forest_of_many_leaves(spark, options):
    """Planted pairs just above 0.98 and a crowd of near copies, over many leaves and, with few sampled, over rounds: equal to brute force."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 24))
    x[700:1000] = x[:300] + 0.19 / np.sqrt(24) * np.linalg.norm(x[:300], axis=1, keepdims=True) * rng.normal(size=(300, 24)) * 0.95
    x[1200:1400] = x[5] + 0.1 * rng.normal(size=(200, 24))
    df = spark.createDataFrame([(i, v.tolist(), i % 3 == 0 and 1 or 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([i % 3 == 0 for i in range(1500)])
    near = (unit @ unit.T >= 0.98) & ~np.eye(1500, dtype=bool) & (label[:, None] == label[None])
    got = {r.vec_id: r.n_links for r in forest.near_vectors(df, **options).collect()}
    found = np.array([got[i] for i in range(1500)])
    assert (found <= near.sum(1)).all() and near.sum() > 1000  # no link that isn't there, none counted twice
    assert found.sum() >= 0.97 * near.sum()


def test_tree_splits():
    rng = np.random.default_rng(1)
    x = forest.unit(rng.normal(size=(4000, 32)))
    tree = forest.grow(x, 4000, rng, gap=0.2 / np.sqrt(32))
    rows, leaf = tree.leaves(x)
    assert len(set(leaf.tolist())) >= 12 and len(rows) < 1.6 * 4000 and set(rows.tolist()) == set(range(4000))
    big = np.full((2, 3), 1e200)
    assert np.allclose(forest.unit(big), 1 / np.sqrt(3))


@pytest.mark.parametrize("options, rows", [({"sample": 2000}, 3000), ({"sample": 400, "part": 4}, 2000)])
def test_search_through_parts(spark, options, rows):
    """With several parts, and with parts cut again, a query visits few of them and finds at least 0.9 of its neighbours."""
    x, _ = _clusters(rows, 12, 24, 5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = df.filter("vec_id % 20 = 0")
    both = routing.placed(df, asked, **options)
    parts = both.filter("NOT asks").select("part").distinct().count()
    routes = both.filter("asks").count() / asked.count()
    assert parts >= 8 and routes < 0.7 * parts
    assert both.filter("NOT asks").count() == rows  # every row is indexed once
    found = {}
    for r in routing.search(df, asked, top=20, **options).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    score = x @ x.T
    hits = 0
    for q in range(0, rows, 20):
        best = sorted((-score[q, i], i) for i in range(rows) if i != q)[:20]
        hits += len(found[q] & {i for _, i in best})
    assert hits >= 0.9 * 20 * len(range(0, rows, 20))


def test_routing_parts():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 8)) + 6 * np.eye(8)[rng.integers(0, 8, 600)]
    graph = routing.neighbours(x, 10)
    label = routing.balanced_parts(graph, 8, rng)
    assert np.bincount(label).min() >= 70 and (label[graph] == label[:, None]).mean() > 0.6


def test_mixing(spark, odd):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.choice([0, 3, 50, 400])), f"s{i % 5}" if i % 7 else None) for i in range(10, 400)]
    df = odd.select("doc_id", "text", "source", "size").unionByName(spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit(7)))
    took, plan = mixing.mix(df, block=64)
    got = took.collect()
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        assert r["size"] == len(WORD.findall(r.text or ""))
        own = by.setdefault(r.source, [0, 0, r.source_size, r.target])
        own[0] += r["size"]
        own[1] += r.taken
    assert len(got) == df.count() and all(n == size and abs(t - goal) < 1 for n, t, size, goal in by.values())
    assert sum(g for *_, g in by.values()) == pytest.approx(1.5 * sum(n for n, *_ in by.values()))
    for own in {r.source for r in plan.collect()}:
        ranks = sorted(r["rank"] for r in plan.collect() if r.source == own)
        assert ranks == list(range(len(ranks)))
    assert sorted(r.taken for r in mixing.mix(df, block=64)[0].collect()) == sorted(r.taken for r in got)
    again = mixing.sizes(mixing.mixed_texts(df.drop("size"), block=64)).agg(F.sum("size")).first()[0]
    assert abs(again - sum(r.taken for r in got)) <= 2
    assert mixing.mix(df.limit(0))[0].collect() == [] and mixing.mixed_texts(df.limit(0)).collect() == []
    assert mixing.water(np.array([5.0, 2, 1]), np.array([10.0, 100, 100]), 100).tolist() == [10.0, 60.0, 30.0]


@pytest.mark.parametrize("url, host, path, rule, verdict", [
    ("http://A.Example.ORG/es/1?x", "a.example.org", "/es/1", "example.org/es/", "block"), ("http://b.example.org/en/12", "b.example.org", "/en/12", "example.org/en/1", "block"),
    ("https://x.org/", "x.org", "/", "org/", "allow"), ("http://x.com/fr/a#b", "x.com", "/fr/a", "com/fr/", "allow"), ("http://com/de/", "com", "/de/", "com/de/", "block"),
    (None, "", "", None, None), ("no scheme", "", "", None, None), ("http://x.org?q", "x.org", "", None, None), ("://", "", "", None, None), ("http://notorg/x", "notorg", "/x", None, None),
    ("http://best-casino-slots.biz/free-spins", "best-casino-slots.biz", "/free-spins", None, "block"), ("http://www.library.net/en/77", "www.library.net", "/en/77", None, "allow"),
])
def test_urls(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(1, url, "x")], "page_id long, url string, host string")
    r = urls.judge(df, [urls.rule(*x) for x in URL_RULES], urls.fit()).first()
    assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or r.verdict == verdict)
    assert urls.judge(df.limit(0), [], urls.fit()).collect() == []


@pytest.mark.parametrize("module", [rules, factorization])
def test_classifiers(spark, odd, module):
    rng, rows = random.Random(7), []
    for i in range(1200):
        bad = rng.random() < 0.3
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randint(20, 60))]
        if bad:
            words = [w + "!!" for w in words[:-2]] + ["idiot", "loser"]
        rows.append((i + 1000, " ".join(words), int(bad)))
    data = spark.createDataFrame(rows, "doc_id long, text string, y int")
    docs = odd.select("doc_id", "text", "score").unionByName(data.select("doc_id", "text", F.lit(0.1).alias("score")))
    labels = data.select("doc_id", F.col("y").alias("toxic")).union(spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int"))
    model = module.fit(docs, labels, "toxic")
    out = module.score(docs, model).join(data.select("doc_id", "y"), "doc_id", "left").collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out and r.y is not None]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out if r.doc_id is not None)
    assert len(held) > 200 and np.mean([(r.score >= 0.5) == r.y for r in held]) > 0.95
    empty = module.fit(docs, labels.limit(0), "toxic")
    assert all(0 <= r.score <= 1 for r in module.score(docs, empty).collect())
    assert module.score(docs.limit(0), model).collect() == []


def test_rules_by_hand(spark, odd):
    """A rule as numpy reads it, as SQL, and worked out from the text: one score."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["ab", "Cde,", "x|y", "12", "fim."]) for _ in range(rng.randint(1, 30)))) for i in range(100, 140)]
    model = rules.RuleModel(-0.25, ((rules.Rule((("log_words", True, 2.0), ("commas", False, 0.1))), 1.5), (rules.Rule((("pipes", False, 0.15),)), -2.0)))
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    for r in rules.score(docs.withColumn("row", F.lit(1)).withColumn("_t", F.lit(2)), model).collect():
        t = r.text or ""
        n = max(1, len(WORD.findall(t)))
        x = {"log_words": np.array([np.log(n)]), "commas": np.array([t.count(",") / n]), "pipes": np.array([t.count("|") / n])}
        z = -0.25 + sum(w * rule.holds(x)[0] for rule, w in model.rules)
        assert r.score == pytest.approx(1 / (1 + np.exp(-z))) and (r.row, r._t) == (1, 2)
        assert r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 4 == 2)


def test_machine_by_pairs(spark, odd):
    """The machine's score is the sum over all pairs of a text's terms, written out."""
    docs = odd.select("doc_id", "text").filter("doc_id <> 4").union(spark.createDataFrame([(50, "idiot, you loser; idiot group"), (51, "a b c d e")], "doc_id long, text string"))
    rng, terms = np.random.default_rng(2), {}
    for r in docs.collect():
        raw = np.frombuffer((r.text or "").encode(), np.uint8)
        terms[r.doc_id, r.text] = factorization.terms(raw, np.array([0, len(raw)]))[1].tolist() if len(raw) else []
    buckets = np.unique(np.concatenate([np.array(t, np.int64) for t in terms.values()]))
    m = factorization.Machine(factorization.BITS, -0.3, buckets, rng.normal(size=len(buckets)), rng.normal(size=(len(buckets), 3)))
    at = {b: i for i, b in enumerate(buckets.tolist())}
    for r in factorization.score(docs, m).collect():
        own = [at[b] for b in terms[r.doc_id, r.text]]
        z = m.b + sum(m.w[i] for i in own) + sum(float(m.v[i] @ m.v[j]) for i, j in itertools.combinations(own, 2))
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)))


def test_url_scores_by_hand():
    """Distinct n-grams of bytes, their mean weight by the root of their number: one url at a time, in plain Python."""
    import pyarrow as pa

    model = urls.fit()
    cases = [("example.org", "/en/1"), ("", ""), ("ÀÉ.org", "/Ação/日本"), ("a", "/"), ("example.org", "/EN/1")]
    got = model.scores(pa.array([h for h, _ in cases]), pa.array([p for _, p in cases]))
    mask = (1 << 64) - 1

    def bucket(salt, n, gram):
        h = 0
        for b in gram:
            h = (h * int(urls.BASE) + int(urls.BYTE[b])) & mask
        return int(urls.mix(np.array([h ^ (salt + 256 * n)], np.uint64))[0]) >> (64 - model.bits)

    for (host, path), score in zip(cases, got):
        own = set()
        for salt, text in ((0x68, host), (0x70, path.lower())):
            data = f"^{text}$".encode()
            own |= {bucket(salt, n, data[i : i + n]) for n in (3, 4, 5) for i in range(len(data) - n + 1)}
        z = model.bias + sum(model.weights[b] for b in own) / np.sqrt(max(1, len(own)))
        assert score == pytest.approx(1 / (1 + np.exp(-z)))


def test_set_names_that_clash(spark, monkeypatch):
    """Different sets with one 64-bit name are told apart by the other."""
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(12))) for i in range(6)] + [(9, " ".join(f"w0_{k}" for k in range(12)))]
    signed = stage(chosenpath.signatures(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("set_id", F.lit(7).cast("long")), "signed")
    monkeypatch.setattr(chosenpath, "signatures", lambda docs, k=5: signed)
    got = chosenpath.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (9, 0)]


def test_interaction_terms():
    """An insult alone or a group alone is harmless, both together are not: no additive weights can say so."""
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(3000):
        a, b = rng.random(2) < 0.5
        rows.append(sorted({*([0] if a else []), *([1] if b else []), int(rng.integers(2, 30))}))
        y.append(float(a and b))
    k, at = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    b, w, v = factorization.descend(k, at, np.array(y), 30, 0.0, 4, 30, 1)
    m = factorization.Machine(5, b, np.arange(30), w, v)
    s = m.scores(np.array([0, 1, 2, 2]), np.array([0, 1, 0, 1]), 3)
    assert s[2] > 0.5 > max(s[0], s[1])


def test_pipeline_stages(spark, sf):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near-dedup", "repeated passages", "mixing", "packing"]
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def test_pipeline_on_odd_rows(spark, odd, sf, tmp_path):
    """Each stage takes null, empty, blank and very long texts, null and repeated ids, clashing names and an empty table."""
    docs = odd.withColumn("lang", F.lit("pt")).withColumn("n_chars", F.length("text"))
    labels = spark.createDataFrame([(i, 0, int(i % 9 == 0)) for i in range(100, 200)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, step in corpus_pipeline.STAGES:
        got = step(spark, docs, f"file://{tmp_path}")
        n = got.count()
        assert n > 0, name
        if name != "packing":
            assert got.columns == docs.columns, name
            assert {(r.kept, r.length) for r in got.collect()} == {(True, "x")}, name
        if name in ("toxicity", "repeated passages"):
            assert n == docs.count(), name
        if name == "near-dedup":  # 5 twice and "um  dois", "Um Dois" are one text of words
            assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "2", "3", "4", "5", "7", "None"]
        assert step(spark, docs.limit(0), f"file://{tmp_path}").collect() == [], name


def test_pipeline_by_hand(spark, tmp_path):
    """Ten documents whose way through every stage is plain to see: what stays, what goes, what is taken twice."""
    word = lambda a, b: " ".join(f"palavra{i}" for i in range(a, b))
    passage = word(1000, 1060)
    texts = {
        1: word(0, 60), 2: word(0, 60), 3: word(1, 61), 4: word(100, 160) + " " + passage, 5: word(200, 260) + " " + passage, 6: word(300, 400), 7: "", 8: None, 9: word(400, 440), 10: "insulto idiota imbecil " + word(500, 540),
    }
    train = [(i, "insulto idiota imbecil " * 3 + word(i, i + 20), 1) if i % 3 == 0 else (i, word(2 * i, 2 * i + 30), 0) for i in range(2000, 2600)]
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in train], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    row = lambda i, t: (i, t, "pt", "s", len(t or ""))
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.createDataFrame([row(i, t) for i, t in texts.items()] + [row(i, t) for i, t, _ in train], kind)
    left = stages["toxicity"](spark, docs, f"file://{tmp_path}").filter("doc_id <= 10")
    assert sorted(r.doc_id for r in left.collect()) == [1, 2, 3, 4, 5, 6, 7, 8, 9]
    left = stages["near-dedup"](spark, left, "")
    assert sorted(r.doc_id for r in left.collect()) == [1, 4, 5, 6, 7, 8, 9]  # 2 is 1, 3 shares 55 of 57 shingles with it
    left = stage(stages["repeated passages"](spark, left, ""), "left")
    kept = {r.doc_id: r.text for r in left.collect()}
    # what 159 and 259 end with is repeated too
    assert kept[4] == texts[4] and kept[5] == word(200, 260)[:-2] and kept[1] == texts[1] and kept[7] == "" and kept[8] == ""
    mixed = stages["mixing"](spark, left, "").collect()
    size = sum(len(WORD.findall(t)) for t in kept.values())
    taken = sum(len(WORD.findall(r.text)) for r in mixed)
    assert taken == int(1.5 * size) and {r.doc_id for r in mixed} == {1, 4, 5, 6, 9}  # one source: 1.5 times all its words
    assert all((kept[r.doc_id] + " ").startswith(r.text + " ") for r in mixed)
    packed = stages["packing"](spark, spark.createDataFrame(mixed, kind), "").collect()
    tok = Tokenizer.from_file(TOKENIZER)
    want = sorted((r.doc_id, zlib.crc32(np.array([*tok.encode(r.text, add_special_tokens=False).ids, 2], "<u4").tobytes())) for r in mixed)
    assert sorted((r.doc_id, r.ids_crc32) for r in packed) == want
