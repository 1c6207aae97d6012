"""Packing token sequences: first-fit decreasing over a tournament tree of bin capacities, in randomised groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.llm import exchange as X
from driftwood.llm.encode import encoder, public_path, slices

LENGTH = 4096
#: Bytes of text whose pieces are packed together.
GROUP_BYTES = 8 << 20
PIECE = "doc_id long, start long, length long, doc_tokens long, ids binary"
PACKED = "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long"
_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])


class Bins:
    """Bins in order of opening, in a tree whose nodes hold the most room below them."""

    def __init__(self, capacity: int, most: int):
        self.leaves = 1 << max(0, (most - 1).bit_length())
        self.capacity = capacity
        # every bin there could be is open with full room, so the first that fits is a new one if no other does
        self.room = [capacity] * (2 * self.leaves)

    def put(self, size: int) -> tuple[int, int]:
        """The first bin that has room for `size`, and the offset in it."""
        room, k = self.room, 1
        while k < self.leaves:
            k *= 2
            if room[k] < size:
                k += 1
        offset = self.capacity - room[k]
        room[k] -= size
        bin_ = k - self.leaves
        while k > 1:
            k //= 2
            most = max(room[2 * k], room[2 * k + 1])
            if room[k] == most:
                break
            room[k] = most
        return bin_, offset


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size; equal sizes go in their given order."""
    bins = Bins(capacity, max(1, len(sizes)))
    at = np.zeros((len(sizes), 2), np.int64)
    for k in np.argsort(-sizes, kind="stable").tolist():
        at[k] = bins.put(int(sizes[k]))
    return at[:, 0], at[:, 1]


def _cut(path: str, end_id: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            docs, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
            for a, z in slices(texts):
                rows = []
                for doc, ids in zip(docs[a:z], enc.encode([t or "" for t in texts[a:z]])):
                    ids += end
                    n = len(ids) // 4
                    rows += [(doc, k, min(length, n - k), n, ids[4 * k : 4 * (k + length)]) for k in range(0, n, length)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECE)], schema=_PIECE)
        X.give_back()

    return run


def _packed(length: int):
    def run(t: pa.Table) -> pa.Table:
        # an order that doesn't depend on how rows arrive
        t = t.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("length", "ascending"), ("ids", "ascending")])
        bins, offset = first_fit_decreasing(t["length"].to_numpy(), length)
        group = t["grp"][0].as_py()
        return t.drop_columns(["grp"]).append_column("sequence_id", pa.array(bins + (group << 32))).append_column("offset", pa.array(offset))

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, length: int = LENGTH) -> DataFrame:
    """Pack all documents into sequences of at most `length` tokens; one row per piece.

    A document is its text's ids (null: none) and end_id, cut every `length` ids; pieces of that size fill a sequence,
    the rests are packed first-fit decreasing.  Pieces are dealt by a hash into groups that hold about GROUP_BYTES of
    text, each packed on its own; a group can only waste room in its last few sequences.  Returns doc_id, start (ids of
    the document before the piece), length, doc_tokens, ids (little-endian unsigned 32-bit), sequence_id and offset.
    Rows that repeat a doc_id are documents of their own; other columns are ignored; no rows give no rows.
    """
    if length < 1:
        raise ValueError("length must be positive")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    groups = X.parts_of(X.text_bytes(docs, row=X.ROW_BYTES), GROUP_BYTES)
    pieces = docs.mapInArrow(_cut(tokenizer or public_path("word_bpe_49k.json"), end_id, length), PIECE)
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "start", "ids"), F.lit(groups)))
    return dealt.groupBy("grp").applyInArrow(_packed(length), PACKED)
