"""Token-id files: bit-plane shuffling.

A chunk holds the ids of whole documents in a row.  Its ids, padded to fixed-size blocks, are transposed into bit
planes (or byte planes), and each plane is compressed with zstandard.  Chunks are rows of Parquet files, so any store
that Spark writes will do and a task that is run again leaves no second copy; an index has each chunk's place.

A chunk's value: magic, ids, ids in a block, bits in a plane, planes; the compressed size of each plane; the planes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwood.llm import exchange as X
from driftwood.llm.encode import encoder, public_path, slices

MAGIC = b"DWP1"
_HEAD = struct.Struct("<4sqiii")
#: Ids in a transposed block, and ids that fill a chunk.
BLOCK, CHUNK = 8192, 1 << 18
#: Bytes of text that one task writes.
TASK_BYTES = 16 << 20
CHUNKS = "shard int, chunk int, shard_start long, n_ids long, docs array<bigint>, doc_ids_count array<int>, payload binary"
_CHUNKS = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("shard_start", pa.int64()), ("n_ids", pa.int64()), ("docs", pa.list_(pa.int64())), ("doc_ids_count", pa.list_(pa.int32())), ("payload", pa.binary())])
_READ = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("shard_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def shuffle_planes(ids: np.ndarray, block: int = BLOCK, bits: int = 1, level: int = 3) -> bytes:
    """Ids (unsigned 32-bit) as a chunk's value; bits: 1 for bit planes, 8 for byte planes."""
    n = len(ids)
    padded = np.zeros(-(-n // block) * block, "<u4")
    padded[:n] = ids
    most = max(1, int(padded.max()).bit_length() if n else 1)
    planes = []
    for at in range(0, most, bits):
        part = (padded >> np.uint32(at)).reshape(-1, block)
        plane = np.packbits((part & 1).astype(np.uint8), axis=1) if bits == 1 else (part & 0xFF).astype(np.uint8)
        planes.append(zstandard.ZstdCompressor(level=level).compress(plane.tobytes()))
    return _HEAD.pack(MAGIC, n, block, bits, len(planes)) + struct.pack(f"<{len(planes)}q", *map(len, planes)) + b"".join(planes)


def join_planes(data: bytes) -> np.ndarray:
    """The ids of a chunk's value."""
    magic, n, block, bits, planes = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a chunk of ids")
    sizes = struct.unpack_from(f"<{planes}q", data, _HEAD.size)
    at, blocks = _HEAD.size + 8 * planes, -(-n // block)
    out = np.zeros((blocks, block), "<u4")
    for k, size in enumerate(sizes):
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at : at + size], max_output_size=max(1, blocks * -(-block * bits // 8))), np.uint8)
        part = np.unpackbits(raw.reshape(blocks, -(-block // 8)), axis=1, count=block) if bits == 1 else raw.reshape(blocks, block)
        out |= part.astype("<u4") << np.uint32(k * bits)
        at += size
    return out.ravel()[:n]


def _write(path: str, end_id: int, chunk: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, shard = encoder(path), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        held: list[tuple[int, bytes]] = []
        size = done = chunks = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, done, chunks
            counts = [len(x) // 4 for _, x in held]
            ids = np.frombuffer(b"".join(x for _, x in held), "<u4")
            row = [[shard], [chunks], [done], [len(ids)], [[d for d, _ in held]], [counts], [shuffle_planes(ids, bits=bits)]]
            held, size, done, chunks = [], 0, done + len(ids), chunks + 1
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, _CHUNKS)], schema=_CHUNKS)

        for batch in batches:
            docs, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
            for a, z in slices(texts):
                for doc, ids in zip(docs[a:z], enc.encode([t or "" for t in texts[a:z]])):
                    held.append((doc, ids + end))
                    size += len(ids) // 4 + 1
                    if size >= chunk:
                        yield flush()
        if held:
            yield flush()
        X.give_back()

    return run


def write_ids(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 0, chunk: int = CHUNK, bits: int = 1) -> None:
    """Write the ids of all documents, each with end_id after it, in ascending doc_id order: folder/chunks and folder/index.

    Null texts have no ids but end_id; a null doc_id comes first; rows that repeat a doc_id follow each other, by
    a hash of the text.  The
    index has, per chunk, its shard (task), number, first id's place among all ids, ids and documents.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tasks = X.parts_of(X.text_bytes(docs, row=X.ROW_BYTES), TASK_BYTES)
    # rows of one doc_id, or without one, are many tasks' work too
    ordered = docs.repartitionByRange(tasks, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    rows = ordered.mapInArrow(_write(tokenizer or public_path("byte_bpe_50k.json"), end_id, chunk, bits), CHUNKS)
    rows.write.option("compression", "none").parquet(f"{folder}/chunks")
    chunks = docs.sparkSession.read.schema(CHUNKS).parquet(f"{folder}/chunks")
    # one row per writing task goes through the window
    shards = chunks.groupBy("shard").agg(F.sum("n_ids").alias("ids")).withColumn("base", F.sum("ids").over(Window.orderBy("shard")) - F.col("ids"))
    index = chunks.join(shards, "shard").select("shard", "chunk", (F.col("base") + F.col("shard_start")).alias("start"), "n_ids", F.size("docs").alias("n_docs"), "base")
    index.coalesce(1 + tasks // 1000).write.parquet(f"{folder}/index")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            stop = np.cumsum(r["doc_ids_count"])
            start = stop - r["doc_ids_count"]
            data = join_planes(r["payload"]).tobytes()
            ids = [data[4 * a : 4 * z] for a, z in zip(start.tolist(), stop.tolist())]
            rows = [r["docs"], [r["shard"]] * len(ids), (start + r["shard_start"]).tolist(), r["doc_ids_count"], ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _READ)], schema=_READ)
    X.give_back()


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit) from the files."""
    docs = spark.read.schema(CHUNKS).parquet(f"{folder}/chunks").mapInArrow(_read, "doc_id long, shard int, shard_start long, n_tokens long, ids binary")
    # one row per writing task; Spark broadcasts it if the file is small
    base = spark.read.parquet(f"{folder}/index").groupBy("shard").agg(F.first("base").alias("base"))
    return docs.join(base, "shard").select("doc_id", (F.col("base") + F.col("shard_start")).alias("start"), "n_tokens", "ids")
