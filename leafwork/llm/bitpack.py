"""Fixed-width bit packing of token ids, and a file of packed documents with random access.

File: 16 bytes of head (magic, bits), blocks of BLOCK ids packed in `bits` bits each (the last is padded), then a
footer of numpy arrays: doc ids, doc ends (ids up to and with the document), byte offset and crc32 of each block;
last 24 bytes: number of documents, number of blocks, magic.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from leafwork.llm.common import partitions, shared_dir, small_batches
from leafwork.llm.encoder import encoder
from leafwork.llm.textbytes import buffers, chunks

MAGIC = b"LWBITS01"
BLOCK = 1 << 16
_NO_ID = -(1 << 63)


def width(vocab: int) -> int:
    """The least number of bits that hold every id below vocab."""
    return max(1, int(vocab - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids, each in `bits` bits, least significant first; padded to 64 ids, in which lanes repeat word for word."""
    n = -(-len(ids) // 64) * 64
    lanes = np.zeros(n, np.uint64)
    lanes[: len(ids)] = ids
    lanes = lanes.reshape(-1, 64)
    out = np.zeros((len(lanes), bits), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        out[:, word] |= lanes[:, j] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= lanes[:, j] >> np.uint64(64 - shift)
    return out.astype("<u8").tobytes()


def unpack(data, bits: int, n: int) -> np.ndarray:
    """The first n ids of packed data."""
    words = np.frombuffer(data, "<u8").reshape(-1, bits)
    out = np.empty((len(words), 64), np.uint64)
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        lane = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            lane |= words[:, word + 1] << np.uint64(64 - shift)
        out[:, j] = lane & mask
    return out.reshape(-1)[:n].astype(np.uint32)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system of a path or URI (local, hdfs, s3 and others)."""
    if urlparse(path).scheme in ("", "file"):
        return pafs.LocalFileSystem(), urlparse(path).path
    return pafs.FileSystem.from_uri(path)


class Writer:
    """Appends documents to a packed file; one block of ids is held at a time. close() puts it in place in one step."""

    def __init__(self, path: str, bits: int):
        self.fs, self.path = filesystem(path)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.fs.open_output_stream(self.part)
        self.out.write(MAGIC + struct.pack("<q", bits))
        self.bits, self.at, self.n = bits, 16, 0
        self.rest = np.zeros(0, np.uint32)
        self.documents = 0
        self.docs, self.ends, self.offsets, self.crcs = [], [], [], []

    def _block(self, ids: np.ndarray):
        data = pack(ids, self.bits)
        self.offsets.append(self.at)
        self.crcs.append(zlib.crc32(data))
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_ids: np.ndarray, ids: np.ndarray, ends: np.ndarray):
        """Documents in a row: their ids, and where each ends among them."""
        if len(ids) and int(ids.max()) >> self.bits:
            raise ValueError(f"an id needs more than {self.bits} bits")
        self.docs.append(np.asarray(doc_ids, "<i8"))
        self.documents += len(doc_ids)
        self.ends.append(ends + self.n)
        self.n += len(ids)
        self.rest = np.concatenate([self.rest, ids])
        full = len(self.rest) // BLOCK * BLOCK
        for k in range(0, full, BLOCK):
            self._block(self.rest[k : k + BLOCK])
        self.rest = self.rest[full:]

    def close(self):
        if len(self.rest):
            self._block(self.rest)
        for parts in (self.docs, self.ends):
            for a in parts:
                self.out.write(a.astype("<i8").tobytes())
        for a in (self.offsets, self.crcs):
            self.out.write(np.array(a, "<i8").tobytes())
        self.out.write(struct.pack("<qq", self.documents, len(self.offsets)) + MAGIC)
        self.out.close()
        self.fs.move(self.part, self.path)  # a repeated task puts the same file in place again


class Reader:
    """Random access to a packed file: ids(i) reads only the blocks that hold document i."""

    def __init__(self, path: str):
        fs, at = filesystem(path)
        self.file = fs.open_input_file(at)
        size = self.file.size()
        head = self.file.read_at(16, 0)
        n_docs, n_blocks = struct.unpack("<qq", self.file.read_at(24, size - 24)[:16])
        if head[:8] != MAGIC:
            raise ValueError(f"{path} is no packed file")
        self.bits = struct.unpack("<q", head[8:])[0]
        foot = np.frombuffer(self.file.read_at(16 * (n_docs + n_blocks), size - 24 - 16 * (n_docs + n_blocks)), "<i8")
        self.docs, self.ends = foot[:n_docs], foot[n_docs : 2 * n_docs]
        self.offsets, self.crcs = foot[2 * n_docs : 2 * n_docs + n_blocks], foot[2 * n_docs + n_blocks :]
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)[:n_docs]
        self.n = int(self.ends[-1]) if n_docs else 0

    def block(self, k: int) -> np.ndarray:
        n = min(BLOCK, self.n - k * BLOCK)
        data = self.file.read_at(-(-n // 64) * 8 * self.bits, int(self.offsets[k]))
        if zlib.crc32(data) != self.crcs[k]:
            raise OSError(f"block {k} is damaged")
        return unpack(data, self.bits, n)

    def span(self, start: int, end: int) -> np.ndarray:
        if end <= start:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, (end - 1) // BLOCK
        got = np.concatenate([self.block(k) for k in range(first, last + 1)])
        return got[start - first * BLOCK : end - first * BLOCK]

    def ids(self, i: int) -> np.ndarray:
        return self.span(int(self.starts[i]), int(self.ends[i]))

    def close(self):
        self.file.close()


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, added: bool = False, per_file: int = 1 << 16) -> list[dict]:
    """Encodes doc_id, text and writes one packed file per range of doc_id into folder; returns the list of files.

    Documents stand in ascending doc_id order (null first; equal ids by a hash of the text, so that repeated ids part
    over tasks too), each ends with end_id; a null or empty text is end_id alone. The list has a row per file (path,
    documents, ids, first id's place among all ids): about `per_file` documents in each, and at least one file a shuffle
    partition, never one per document. Columns beside doc_id and text are left aside. added: see Encoder.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = max(partitions(spark), -(-docs.count() // per_file))

    def encoded(batches):
        enc = encoder(tokenizer, added)
        k = TaskContext.get().partitionId()
        path = f"{folder}/ids-{k:06d}.bin"
        out = Writer(path, width(enc.vocab))
        for batch in batches:
            texts = batch.column("text")
            doc = batch.column("doc_id").fill_null(_NO_ID).to_numpy()
            for a, b in chunks(buffers(texts)[1], 4 << 20):
                ids, ends = enc.encode(texts.slice(a, b - a))
                places = ends[1:] + np.arange(1, b - a + 1)
                full = np.empty(len(ids) + b - a, np.uint32)
                full[places - 1] = end_id
                gap = np.ones(len(full), bool)
                gap[places - 1] = False
                full[gap] = ids
                out.add(doc[a:b], full, places)
        out.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int64()), "path": [path], "docs": pa.array([out.documents], pa.int64()), "ids": pa.array([out.n], pa.int64())})

    hashed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("_x"))
    sorted_docs = hashed.repartitionByRange(n, "doc_id", "_x").sortWithinPartitions("doc_id", "_x").drop("_x")
    fs, at = filesystem(folder)
    fs.create_dir(at, recursive=True)
    files = [r.asDict() for r in sorted_docs.mapInArrow(encoded, "part long, path string, docs long, ids long").collect()]
    base = 0
    for f in sorted(files, key=lambda f: f["part"]):
        f["base"] = base
        base += f["ids"]
    return sorted(files, key=lambda f: f["part"])


def read(spark: SparkSession, files: list[dict]) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, tokens (bytes of little-endian uint32) of the files' documents."""
    rows = [(f["path"], f["base"]) for f in files if f["docs"]] or [("", 0)]
    listed = spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows)), "path")

    def decoded(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                if not path:
                    continue
                src = Reader(path)
                for a, b in chunks(np.concatenate([[0], src.ends]), 1 << 19):
                    ids = src.span(int(src.starts[a]), int(src.ends[b - 1]))
                    data = ids.astype("<u4").tobytes()
                    cut = (src.ends[a:b] - src.starts[a]) * 4
                    tokens = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(np.concatenate([[0], cut]).astype(np.int32)), pa.py_buffer(data)])
                    doc = pa.array(src.docs[a:b], mask=src.docs[a:b] == _NO_ID)
                    yield pa.RecordBatch.from_arrays([doc, pa.array(src.starts[a:b] + base), pa.array(src.ends[a:b] - src.starts[a:b]), tokens], ["doc_id", "start", "n_tokens", "tokens"])
                src.close()

    return listed.mapInArrow(decoded, "doc_id long, start long, n_tokens long, tokens binary")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0, added: bool = False) -> DataFrame:
    """Writes packed files into the shared folder and reads them back; crc32 of each document's ids beside them."""
    spark = docs.sparkSession
    files = write(docs, f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}", tokenizer, end_id, added)
    return read(spark, files).withColumn("ids_crc32", F.crc32("tokens"))
