"""Benchmark decontamination: winnowing.

A window of `window` words has a fingerprint, the smallest hash of the `GRAM` -word grams in it; a text's fingerprints
are the minima over all its windows.  If two texts share a window they share its fingerprint, so every shared span of
`window` words or more is found by joining fingerprints.  Of documents that share one, the windows that have it are
taken and joined to the benchmark's by all their words, and hits that touch are one span.

The benchmark is a table like any other: its windows are cut by tasks and never pass through the driver.  Spark
broadcasts it to a join where its measured size is small and shuffles both sides where it is not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwood.llm import exchange as X

WINDOW = 10
GRAM = 5
#: Letters and digits of ASCII, lower-cased, and all other characters are kept; the rest of ASCII parts words.
_WORD_BYTES = bytes(c if c > 0x7F or chr(c).isalnum() else 0x20 for c in range(256)).lower()
_PRIME = 0x9E3779B97F4A7C15
SPANS = "array<struct<start:int,stop:int>>"


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_WORD_BYTES).split()


class _Texts:
    """Some texts as one row of word hashes."""

    def __init__(self, texts: list[bytes | None]):
        words = [words_of(t) if t else [] for t in texts]
        self.n = np.array([len(w) for w in words], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.n)])
        self.words = [x for w in words for x in w]
        self.hash = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words))
        self.of = np.repeat(np.arange(len(words)), self.n)

    def prints(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the windows of n words that lie in one text, and the fingerprint of each; different n have different ones."""
        m = max(0, len(self.hash) - n + 1)
        gram = min(GRAM, n)
        low = X.lowest(X.run_hashes(self.hash, gram, _PRIME), n - gram + 1, m)
        at = np.flatnonzero(self.of[:m] == self.of[n - 1 :][:m])
        return at, X.mix(low[at] + np.uint64(n)).view(np.int64)

    def window(self, at: int, n: int) -> bytes:
        return b" ".join(self.words[at : at + n])


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[slice, list[bytes | None]]]:
    """Neighbouring rows of a batch of about half a block of text together."""
    texts = batch["text"].cast(pa.binary())
    first, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t.as_py() or b"")
        if size >= X.BLOCK_BYTES // 2 or k == len(texts) - 1:
            yield slice(first, k + 1), texts[first : k + 1].to_pylist()
            first, size = k + 1, 0


def _item_windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in _parts(batch):
                t, ids = _Texts(texts), batch["item_id"].slice(rows.start, len(texts)).to_pylist()
                item, size, print_, words = [], [], [], []
                for n in np.unique(np.minimum(t.n, window)).tolist():
                    if n:
                        at, prints = t.prints(n)
                        own = np.minimum(t.n, window)[t.of[at]] == n
                        at, prints = at[own], prints[own]
                        item += [ids[k] for k in t.of[at].tolist()]
                        size += [n] * len(at)
                        print_ += prints.tolist()
                        words += [t.window(k, n) for k in at.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(size, pa.int32()), pa.array(print_, pa.int64()), pa.array(words, pa.binary())], names=["item", "n", "print", "words"])

    return run


def _fingerprints(sizes: list[int]):
    """Each row's number of words and fingerprints, those equal to the one before left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in _parts(batch):
                t = _Texts(texts)
                of, prints = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for n in sizes:
                    at, p = t.prints(n)
                    new = np.ones(len(at), bool)
                    new[1:] = (p[1:] != p[:-1]) | (t.of[at[1:]] != t.of[at[:-1]])
                    of.append(t.of[at[new]])
                    prints.append(p[new])
                of, prints = np.concatenate(of), np.concatenate(prints)
                order = np.argsort(of, kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(texts)))])
                part = batch.slice(rows.start, len(texts))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(prints[order]))
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["row"], pa.array(t.n, pa.int64()), lists], names=["doc_id", "row", "n_words", "prints"])

    return run


def _candidates(sizes: list[int]):
    """The windows of each row that have one of its wanted fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in _parts(batch):
                t = _Texts(texts)
                part = batch.slice(rows.start, len(texts))
                keys, lists = part["row"].to_pylist(), part["prints"]
                wanted = np.unique(lists.flatten().to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0, np.int64)
                row, first, size, words = [], [], [], []
                for n in sizes:
                    at, p = t.prints(n)
                    at = at[X.among(p, wanted)]
                    row += [keys[k] for k in t.of[at].tolist()]
                    first += (at - t.begin[t.of[at]]).tolist()
                    size += [n] * len(at)
                    words += [t.window(k, n) for k in at.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(row, pa.string()), pa.array(first, pa.int32()), pa.array(size, pa.int32()), pa.array(words, pa.binary())], names=["row", "first", "n", "words"])

    return run


def _row(doc_id: str = "doc_id", text: str = "text") -> Column:
    """What tells rows apart: those that repeat doc_id and text have the same hits."""
    return F.concat_ws(":", F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit("")), F.hex(F.xxhash64(F.col(text).cast("string"))))


def _hits(docs: DataFrame, benchmark: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """All rows (doc_id, row, n_words), and the benchmark's windows in them (row, first, n, item); `docs` has doc_id, text and row."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    windows = X.staged(items.mapInArrow(_item_windows(window), "item string, n int, print long, words binary").distinct(), "windows")
    # at most `window` numbers
    sizes = sorted(r.n for r in windows.select("n").distinct().collect())
    prints = X.staged(docs.mapInArrow(_fingerprints(sizes), "doc_id long, row string, n_words long, prints array<bigint>"), "prints")
    known = X.staged(windows.select("print").distinct(), "known")
    shared = prints.select("row", F.explode("prints").alias("print")).join(known, "print").groupBy("row").agg(F.collect_set("print").alias("prints"))
    wanted = docs.select("row", "text").join(X.staged(shared, "shared"), "row")
    near = wanted.mapInArrow(_candidates(sizes), "row string, first int, n int, words binary")
    found = near.join(windows.select("n", "words", "item"), ["n", "words"]).select("row", "first", "n", "item").distinct()
    return prints.select("doc_id", "row", "n_words"), X.staged(found, "hits")


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted as strings) and spans (word ranges hit), one row per input row.

    Words are runs of ASCII letters and digits (A-Z lower-cased) and characters beyond ASCII.  A window is `window`
    words of an item in a row, or the whole of an item that has fewer; a document's words inside any occurrence of a
    window are hit.  A null text has no words; items without words, text or id have no windows; ids that repeat are
    one item.  Rows of documents may repeat ids or have none; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", _row())
    rows, hits = _hits(docs, benchmark, window)
    items = hits.groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    places = hits.select("row", "first", (F.col("first") + F.col("n")).alias("stop")).distinct()
    w = Window.partitionBy("row").orderBy("first", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    places = places.withColumn("new", F.coalesce((F.col("first") > reach).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(w))
    islands = places.groupBy("row", "island").agg(F.min("first").alias("start"), F.max("stop").alias("stop"))
    spans = islands.groupBy("row").agg(F.sum(F.col("stop") - F.col("start")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    out = rows.join(X.staged(items.join(spans, "row"), "leaks"), "row", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, with all their columns, whose text holds no window of the benchmark."""
    _, hits = _hits(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", _row()), benchmark, window)
    names = docs.columns
    keyed = docs.toDF(*[f"c{k}" for k in range(len(names))]).withColumn("row", _row(f"c{names.index('doc_id')}", f"c{names.index('text')}"))
    return keyed.join(hits.select("row").distinct(), "row", "left_anti").select(*[F.col(f"c{k}").alias(n) for k, n in enumerate(names)])
