"""Shared pieces of the corpus-wide operators: blocks of documents, compact exchange of numpy arrays, shared tables.

A corpus-wide lookup ("which of my hashes occur elsewhere?") runs in two hops.  Documents are dealt into *blocks* of
a fixed size in bytes; each block reduces its documents to distinct sorted keys and sends them, packed, to the *shards*
that own the keys; the shard answers each block.  A key thus costs a shard one entry per block, however many documents
of a block hold it, so hot passages and words are combined before they are shuffled.

What is sent are arrays, one element per key, sorted by the number of the shard (or block) that they go to.  A sender
makes at most `FAN` rows: where there are more targets, a row serves a range of them, and a second hop takes such rows
apart and puts what many senders have for one target together, so rows grow with the bytes sent, not with senders times
targets.
"""

from __future__ import annotations

import ctypes
import math
import struct
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one block of documents holds on average.
BLOCK_BYTES = 8 << 20

#: The characters that end a word: space, tab, newline, vertical tab, form feed, carriage return.
SPACES = " \t\n\v\f\r"


#: What a row counts besides its text, so that very many empty ones are not one group.
ROW_BYTES = 64


def text_bytes(docs: DataFrame, column: str = "text", row: int = 0) -> int:
    """Bytes of UTF-8 in a text column, and `row` for each row; one pass over that column alone."""
    return int(docs.agg(F.sum(F.coalesce(F.octet_length(column), F.lit(0)).cast("long") + row)).first()[0] or 0)


def parts_of(total: int, each: int) -> int:
    """How many parts of `each` bytes hold `total` bytes."""
    return max(1, math.ceil(total / each))


def blocked(docs: DataFrame, n: int) -> DataFrame:
    """The rows and the block of each, dealt by a hash so that blocks are even whatever the keys are."""
    return docs.select("*", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("block"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that spark.checkpoint.dir names, which driver and executors share.

    Where it is unset, a local session (tests) gets a temporary folder; a cluster must name a shared one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="driftwood-"))
        base = sc._jsc.sc().getCheckpointDir().get()
    return f"{base.rstrip('/')}/driftwood-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str = "table") -> DataFrame:
    """The rows of df, written once to the shared folder and read from there: cuts lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def join_evenly(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """rows joined to `table` (one row per key), whose `weight` says how many of the `total` rows hold the key.

    Keys of very many rows would be one task's work: they are sent to every task instead, 100,000 of them at most.
    """
    many = F.col(weight) > max(1_000, total // 100_000)
    hot = F.broadcast(table.where(many).drop(weight))
    return rows.join(hot, key).unionByName(rows.join(F.broadcast(table.where(many).select(key)), key, "left_anti").join(table.where(~many).drop(weight), key))


def give_back() -> None:
    """Return freed memory to the system: Python workers live on between tasks, and stages share an executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value: per array a type, a length and its bytes, transposed by significance.

    Of unsigned 64-bit values the differences are kept, which pack well where they are sorted.
    """
    out = []
    for a in arrays:
        a = np.ascontiguousarray(np.diff(a, prepend=a.dtype.type(0)) if a.dtype == np.uint64 else a)
        planes = a.view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()
        data = zstandard.ZstdCompressor(level=1).compress(planes)
        out.append(struct.pack("<4sqq", a.dtype.str[1:].encode(), len(a), len(data)) + data)
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        kind, n, size = struct.unpack_from("<4sqq", data, at)
        at += struct.calcsize("<4sqq")
        dtype = np.dtype("<" + kind.rstrip(b"\0").decode())
        planes = zstandard.ZstdDecompressor().decompress(data[at : at + size], max_output_size=max(1, n * dtype.itemsize)) if n else b""
        a = np.frombuffer(planes, np.uint8).reshape(dtype.itemsize, n).T.copy().view(dtype).ravel() if n else np.zeros(0, dtype)
        out.append(np.cumsum(a, dtype=a.dtype) if a.dtype == np.uint64 else a)
        at += size
    return out


#: Rows that one sender makes at most.
FAN = 1024
#: Bytes of arrays that a second hop holds before it sends them on.
HELD_BYTES = 32 << 20
HOP = "hop int, payload binary"
HOP_SCHEMA = pa.schema([("hop", pa.int32()), ("payload", pa.binary())])


def _slices(arrays: list[np.ndarray], lengths: int | None, cut: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For a number per element, sorted: each number's elements.  Array `lengths`, if given, tells how many items of the last array are each element's."""
    ends = np.append(np.flatnonzero(cut[1:] != cut[:-1]) + 1, len(cut)) if len(cut) else np.zeros(0, np.int64)
    place = np.concatenate([[0], np.cumsum(arrays[lengths])]).astype(np.int64) if lengths is not None else None
    first = 0
    for end in ends.tolist():
        own = [x[first:end] for x in (arrays if place is None else arrays[:-1])]
        yield int(cut[first]), own if place is None else [*own, arrays[-1][place[first] : place[end]]]
        first = end


def send(arrays: list[np.ndarray], targets: int, lengths: int | None = None) -> pa.Table:
    """Rows (hop, payload) of arrays whose first has each element's target, in order; `lengths` as in receive()."""
    width = -(-targets // FAN)
    rows = [(hop, pack(*own)) for hop, own in _slices(arrays, lengths, arrays[0] // np.uint32(width))]
    return pa.table([[r[0] for r in rows], [r[1] for r in rows]], schema=HOP_SCHEMA)


def routed(sent: DataFrame, targets: int, lengths: int | None = None) -> DataFrame:
    """Rows of send() with the target as their hop."""
    if targets <= FAN:
        return sent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list[np.ndarray]]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            rows = [(k, pack(*map(np.concatenate, zip(*parts)))) for k, parts in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=HOP_SCHEMA)

        for batch in batches:
            for payload in batch["payload"]:
                arrays = unpack(payload.as_py())
                for target, own in _slices(arrays, lengths, arrays[0]):
                    held.setdefault(target, []).append(own)
                size += sum(x.nbytes for x in arrays)
                if size >= HELD_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return sent.repartition("hop").mapInArrow(run, HOP)


def receive(t: pa.Table) -> list[np.ndarray] | None:
    """The arrays of all rows of a target, put together; None without rows."""
    parts = [unpack(x.as_py()) for x in t["payload"]]
    return [np.concatenate(x) for x in zip(*parts)] if parts else None


def cuts_by(shard: np.ndarray, n: int) -> list[tuple[int, slice]]:
    """For a shard number per element, sorted by it: the slice of each shard that has elements."""
    ends = np.searchsorted(shard, np.arange(n + 1))
    return [(k, slice(int(ends[k]), int(ends[k + 1]))) for k in np.unique(shard).tolist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(hashes: np.ndarray, k: int, prime: int) -> np.ndarray:
    """A hash of every run of k neighbours in an array of 64-bit hashes; another prime gives another hash."""
    m = max(0, len(hashes) - k + 1)
    out = np.zeros(m, np.uint64)
    for j in range(k):
        out *= np.uint64(prime)
        out += hashes[j : j + m]
    return mix(out)


def lowest(runs: np.ndarray, wide: int, m: int) -> np.ndarray:
    """The minimum of `wide` neighbours from each of the first m places."""
    low = runs[:m].copy()
    for j in range(1, wide):
        np.minimum(low, runs[j : j + m], out=low)
    return low


def among(x: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    """Which of x are in sorted_keys."""
    if not len(sorted_keys):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)
    return sorted_keys[at] == x


def firsts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    n = len(sorted_keys[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        for k in sorted_keys:
            new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)
