"""Approximate dense search: an inverted file of centroids with product-quantised codes, and exact scores of the best.

An index is a folder: a small model (centroids, codebooks) and Parquet rows of blocks, partitioned by list.  A block
holds some thousand vectors of one list: keys, codes and the vectors themselves in columns of their own, so that a
search reads the codes of the lists that its queries probe, and vectors of those blocks alone in which it has
candidates.  The model is fitted to a bounded sample; every row is in the index.  Only the model and that sample pass
through the driver.  A search of all rows of the probed lists takes slices of blocks against many queries and keeps each
query's best of a slice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from driftwood.operators.staging import staged

#: Rows that the model is fitted to at most: those of the smallest hashes of their keys.
SAMPLE = 65_536
#: Rows of the sample per centroid at least, and centroids of a codebook.
PER_LIST, CODES = 40, 256
#: Rows of the sample that are taken as queries to learn how many lists a recall takes, and hits of each.
TRIED, HITS = 500, 50
#: Recall that a search aims at where it is not told how many lists to probe.
RECALL = 0.95
#: Vectors of a block; queries scored against one at once.
BLOCK, ASKED = 4_096, 1_024
#: Where all rows are scored: rows of a slice, queries that it is scored against in a task, and at once.
SLICE, TURN, TILE = 16_384, 16_384, 128
#: Points that are compared with all means at once.
POINTS = 1_024
#: Digits that scores are rounded to before they are ranked, as in the exact search.
DIGITS = 9


def units(m: np.ndarray) -> np.ndarray:
    """Rows of length 1, as float64; nan where there is no direction."""
    m = m.astype(np.float64)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.full_like(m, np.nan), where=norm > 0)


def centres(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's means, begun from the first k points; a mean without points stays."""
    out = points[:k].copy()
    for _ in range(rounds):
        own = nearest(points, out)
        n = np.bincount(own, minlength=len(out))
        sums = np.zeros_like(out)
        np.add.at(sums, own, points)
        out[n > 0] = sums[n > 0] / n[n > 0, None]
    return out


def nearest(points: np.ndarray, means: np.ndarray) -> np.ndarray:
    half = (means * means).sum(axis=1) / 2
    return np.concatenate([np.zeros(0, np.int64), *(np.argmax(points[i : i + POINTS] @ means.T - half, axis=1) for i in range(0, len(points), POINTS))])


@dataclass
class Model:
    """Centroids of the lists, and per part of a vector a codebook for what is left of it without its centroid."""

    lists: np.ndarray
    books: np.ndarray
    #: Of the sample's nearest neighbours, the share found in the 1, 2, ... nearest lists.
    curve: np.ndarray

    def probes(self, recall: float) -> int:
        """How many lists that share of the sample's neighbours takes."""
        return int(np.searchsorted(self.curve, min(recall, self.curve[-1]))) + 1

    @property
    def width(self) -> int:
        return self.lists.shape[1]

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and codes of unit vectors."""
        own = nearest(unit, self.lists)
        rest = (unit - self.lists[own]).reshape(len(unit), len(self.books), -1)
        codes = np.column_stack([nearest(np.ascontiguousarray(rest[:, p]), book) for p, book in enumerate(self.books)]) if len(unit) else np.zeros((0, len(self.books)))
        return own, codes.astype(np.uint8)

    def decode(self, own: int, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes of one list stand for."""
        rest = np.concatenate([book[codes[:, p]] for p, book in enumerate(self.books)], axis=1)
        return rest + self.lists[own]


def _curve(points: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Share of some points' nearest neighbours among all that lie in their 1, 2, ... nearest lists."""
    own, found = nearest(points, means), np.zeros(len(means))
    asked = points[:: max(1, len(points) // TRIED)]
    for i in range(0, len(asked), 16):
        part = asked[i : i + 16]
        hits = np.argsort(-(part @ points.T), axis=1, kind="stable")[:, :HITS]
        order = np.argsort((means * means).sum(axis=1) / 2 - part @ means.T, axis=1, kind="stable")
        place = np.argsort(order, axis=1)
        found += np.bincount(np.take_along_axis(place, own[hits], axis=1).ravel(), minlength=len(means))
    return np.cumsum(found) / found.sum()


def fit(vectors: DataFrame, key: str, column: str, lists: int | None = None, parts: int | None = None, sample: int = SAMPLE) -> Model:
    """A model from the `sample` rows of the smallest hashes of their keys.  By default the square root of the number of rows are lists, as many as the sample allows."""
    sound = vectors.where(_sound(column))
    n = sound.count()
    m = _smallest(sound, n, key, column, sample)
    size = pc.list_value_length(m).to_numpy()
    width = max(((n, w) for w, n in zip(*np.unique(size, return_counts=True))), default=(0, 1))[1]
    points = units(m.filter(pa.array(size == width)).flatten().to_numpy().reshape(-1, width))
    points = points[~np.isnan(points).any(axis=1)]
    if not len(points):
        return Model(np.zeros((1, 1)), np.zeros((1, 1, 1)), np.ones(1))
    k = lists or max(1, min(round(math.sqrt(n)), len(points) // PER_LIST))
    means = centres(points, min(k, len(points)))
    parts = parts or next(p for p in range(min(width, max(1, width // 4)), 0, -1) if width % p == 0)
    rest = (points - means[nearest(points, means)]).reshape(len(points), parts, -1)
    books = np.stack([centres(np.ascontiguousarray(rest[:, p]), min(CODES, len(points))) for p in range(parts)])
    return Model(means, books, _curve(points, means))


def _smallest(rows: DataFrame, n: int, key: str, column: str, sample: int) -> pa.Array:
    """The vectors of the `sample` rows of the smallest hashes, of n rows; as Arrow, for Python's numbers take many times the room."""
    hashed = F.xxhash64(f"`{key}`")
    # a few more than the sample by calculation, so that executors need not sort all
    share = (sample + 8 * math.sqrt(sample)) / max(1, n)
    for cut in ([math.floor(share * 2**64) - 2**63] if share < 1 else []) + [2**63 - 1]:
        few = rows.where(hashed <= F.lit(cut)).select(F.col(f"`{column}`").cast("array<double>").alias("v"), F.col(f"`{key}`").alias("k"))
        found = few.orderBy(F.xxhash64("k"), "k").limit(sample).select("v").toArrow()["v"].combine_chunks()
        if len(found) == min(n, sample):
            break
    return found


def _sound(column: str):
    v = F.col(f"`{column}`")
    return v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def build(vectors: DataFrame, folder: str, key: str = "chunk_id", column: str = "dense", lists: int | None = None, parts: int | None = None) -> None:
    """Writes an index of all rows to a folder that does not exist yet.

    Vectors are compared by direction; null, zero, unsound vectors and those of another width than most of the sample's are
    in no list, as they have no cosine with a query.  Rows that repeat a key are entries of their own.
    """
    spark = vectors.sparkSession
    model = fit(vectors, key, column, lists, parts)
    rows = [("list", k, m.tolist()) for k, m in enumerate(model.lists)] + [(f"book{p}", k, m.tolist()) for p, book in enumerate(model.books) for k, m in enumerate(book)] + [("curve", 0, model.curve.tolist())]
    spark.createDataFrame(rows, "kind string, n int, mean array<double>").coalesce(1).write.parquet(f"{folder}/model")
    single = isinstance(vectors.schema[column].dataType, ArrayType) and isinstance(vectors.schema[column].dataType.elementType, FloatType)
    dtype = np.float32 if single else np.float64

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, model.width)
            unit = units(m)
            kept = ~np.isnan(unit).any(axis=1)
            own, codes = model.encode(unit[kept])
            raw = [v.tobytes() for v in m[kept].astype(dtype)]
            yield pa.RecordBatch.from_arrays([batch["k"].filter(pa.array(kept)), pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(raw, pa.binary())], names=["k", "list", "code", "vector"])

    kind = vectors.schema[key].dataType.simpleString()
    sound = vectors.where(_sound(column) & (F.size(f"`{column}`") == model.width)).select(F.col(f"`{key}`").alias("k"), F.col(f"`{column}`").alias("v"))
    coded = staged(sound.mapInArrow(encode, f"k {kind}, list int, code binary, vector binary"), "coded")
    # as many rows as lists
    sizes = F.broadcast(coded.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    # rows that repeat a key and vector are spread by what they are not dealt by otherwise
    placed = coded.join(sizes, "list").withColumn("block", F.pmod(F.xxhash64("k", F.monotonically_increasing_id()), F.col("blocks")).cast("int"))

    def pack(t: pa.Table) -> pa.Table:
        join = lambda c: b"".join(x.as_py() for x in t[c])
        keys = pa.array([t["k"].to_pylist()], pa.list_(t["k"].type))
        return pa.table([t["list"].slice(0, 1), t["block"].slice(0, 1), keys, pa.array([join("code")], pa.binary()), pa.array([join("vector")], pa.binary())], names=["list", "block", "keys", "codes", "vectors"])

    packed = staged(placed, "placed").groupBy("list", "block").applyInArrow(pack, f"list int, block int, keys array<{kind}>, codes binary, vectors binary")
    packed.withColumn("single", F.lit(single)).write.partitionBy("list").option("compression", "zstd").parquet(f"{folder}/lists")


class Index:
    """An index that build() has written."""

    def __init__(self, spark: SparkSession, folder: str):
        rows = spark.read.parquet(f"{folder}/model").orderBy("kind", "n").collect()
        of = lambda kind: [r["mean"] for r in rows if r.kind == kind]
        books = sorted({r.kind for r in rows if r.kind.startswith("book")}, key=lambda x: int(x[4:]))
        self.model = Model(np.array(of("list")), np.array([of(b) for b in books]), np.array(of("curve")[0]))
        self.blocks = spark.read.schema(self._schema(spark, folder)).parquet(f"{folder}/lists")

    @staticmethod
    def _schema(spark: SparkSession, folder: str):
        try:
            return spark.read.parquet(f"{folder}/lists").schema
        except Exception as e:
            # of no rows nothing is written
            if "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return "block int, keys array<bigint>, codes binary, vectors binary, single boolean, list int"

    def probed(self, queries: DataFrame, probes: int) -> DataFrame:
        """(q, list, q_unit): the lists whose centroids are nearest to each query; queries without direction have none."""
        model, n = self.model, min(probes, len(self.model.lists))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                unit = units(batch["q_vec"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, model.width))
                kept = np.flatnonzero(~np.isnan(unit).any(axis=1))
                near = (model.lists * model.lists).sum(axis=1) / 2 - unit[kept] @ model.lists.T
                own = np.argsort(near, axis=1, kind="stable")[:, :n]
                raw = pa.array([unit[k].tobytes() for k in kept], pa.binary())
                yield pa.RecordBatch.from_arrays([batch["q"].take(pa.array(np.repeat(kept, n))), pa.array(own.ravel(), pa.int32()), raw.take(pa.array(np.repeat(np.arange(len(kept)), n)))], names=["q", "list", "q_unit"])

        asked = queries.where(_sound("q_vec") & (F.size("q_vec") == model.width)).select("q", "q_vec")
        return asked.mapInArrow(run, f"q {queries.schema['q'].dataType.simpleString()}, list int, q_unit binary")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, rerank: int = 4, key: str = "chunk_id") -> DataFrame:
        """(q, key, score, rank): each query's k rows of greatest cosine among those of its `probes` nearest lists.

        Without `probes` it takes as many lists as held `RECALL` of the neighbours in the sample.  Codes choose rerank x k candidates a query, whose own vectors give the scores; rerank=0 scores all rows of the
        probed lists, so with all lists probed the result is that of the exact search.  Ties go by key.  `queries` has q
        and q_vec; a query without direction hits nothing.
        """
        probes = probes or self.model.probes(RECALL)
        if not rerank:
            return self._every(queries, k, probes, key)
        q_type, k_type = queries.schema["q"].dataType.simpleString(), self.blocks.schema["keys"].dataType.elementType.simpleString()
        probed = staged(self.probed(queries, probes), "probed")
        turns = max(1, math.ceil(queries.count() / ASKED))
        part = F.pmod(F.xxhash64("q"), F.lit(turns)).cast("int").alias("turn")
        asked = probed.groupBy("list", part).agg(F.collect_list(F.struct("q", "q_unit")).alias("asked"))
        model = self.model

        def best(scores: np.ndarray, n: int) -> np.ndarray:
            if len(scores) > n:
                few = np.flatnonzero(scores >= -np.partition(-scores, n - 1)[n - 1])
                return few[np.lexsort((few, -scores[few]))][:n]
            return np.arange(len(scores))

        def by_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for own, block, data, asking in zip(batch["list"].to_pylist(), batch["block"].to_pylist(), batch["codes"].to_pylist(), batch["asked"].to_pylist()):
                    codes = np.frombuffer(data, np.uint8).reshape(-1, len(model.books))
                    scores = np.stack([np.frombuffer(a["q_unit"]) for a in asking]) @ model.decode(own, codes).T
                    hits = [best(s, rerank * k) for s in scores]
                    n = sum(map(len, hits))
                    at = np.concatenate(hits)
                    of = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
                    qs = pa.array([a["q"] for a in asking], batch.schema.field("asked").type.value_type.field("q").type).take(pa.array(of))
                    yield pa.RecordBatch.from_arrays([qs, pa.array([own] * n, pa.int32()), pa.array([block] * n, pa.int32()), pa.array(at, pa.int32()), pa.array(scores[of, at])], names=["q", "list", "block", "at", "about"])

        def by_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for keys, data, single, asking in zip(batch["keys"], batch["vectors"].to_pylist(), batch["single"].to_pylist(), batch["asked"].to_pylist()):
                    unit = units(np.frombuffer(data, np.float32 if single else np.float64).reshape(-1, model.width))
                    for a in asking:
                        at = np.asarray(a["at"], np.int64)
                        scores = np.round(unit[at] @ np.frombuffer(a["q_unit"]), DIGITS)
                        yield pa.RecordBatch.from_arrays([pa.array([a["q"]] * len(at), batch.schema.field("asked").type.value_type.field("q").type), keys.values.take(pa.array(at)), pa.array(scores)], names=["q", key, "score"])

        schema = f"q {q_type}, `{key}` {k_type}, score double"
        found = self.blocks.select("list", "block", "codes").join(asked, "list").mapInArrow(by_codes, f"q {q_type}, list int, block int, at int, about double")
        order = Window.partitionBy("q").orderBy(F.desc("about"), "list", "block", "at")
        kept = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= rerank * k)
        few = kept.groupBy("list", "block", "q").agg(F.collect_list("at").alias("at")).join(probed, ["q", "list"])
        few = few.groupBy("list", "block", part).agg(F.collect_list(F.struct("q", "q_unit", "at")).alias("asked"))
        scored = self.blocks.select("list", "block", "keys", "vectors", "single").join(few, ["list", "block"]).mapInArrow(by_vectors, schema)
        return self._ranked(scored, k, key)

    @staticmethod
    def _ranked(scored: DataFrame, k: int, key: str) -> DataFrame:
        ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), key)) - 1)
        return ranked.where(F.col("rank") < k)

    def _every(self, queries: DataFrame, k: int, probes: int, key: str) -> DataFrame:
        """As search, of all rows of the probed lists: slices of blocks against turns of queries, k rows of each query and slice."""
        model, n_lists = self.model, len(self.model.lists)
        k_type, q_type = self.blocks.schema["keys"].dataType.elementType.simpleString(), queries.schema["q"].dataType.simpleString()
        blocks = self.blocks.select("list", "block", "keys", "vectors", "single")
        if probes < n_lists:
            asked = self.probed(queries, probes)
            # as many rows as lists
            blocks = blocks.where(F.col("list").isin([r.list for r in asked.select("list").distinct().collect()]))
            asked = asked.groupBy("q", "q_unit").agg(F.collect_set("list").alias("lists"))
        else:
            asked = self.probed(queries, 1).select("q", "q_unit", F.lit(None).cast("array<int>").alias("lists"))
        n_slices = max(1, math.ceil((blocks.agg(F.sum(F.size("keys"))).first()[0] or 0) / SLICE))
        n_turns = max(1, math.ceil(queries.count() / TURN))
        each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        dealt = lambda by, n: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
        left = asked.withColumn("turn", dealt(["q"], n_turns)).withColumn("slice", each(n_slices))
        right = blocks.withColumn("slice", dealt(["list", "block"], n_slices)).withColumn("turn", each(n_turns))

        def best(asked: pa.Table, blocks: pa.Table) -> pa.Table:
            out = [pa.table([pa.array([], asked["q"].type), pa.array([], blocks["keys"].type.value_type), pa.array([], pa.float64())], names=["q", key, "score"])]
            if asked.num_rows and blocks.num_rows:
                keys = pc.list_flatten(blocks["keys"]).combine_chunks()
                unit = np.concatenate([units(np.frombuffer(v.as_py(), np.float32 if s.as_py() else np.float64).reshape(-1, model.width)) for v, s in zip(blocks["vectors"], blocks["single"])])
                # in the order of keys, which decide between rows of one score
                order = pc.array_sort_indices(keys, null_placement="at_start")
                keys, unit = keys.take(order), unit[order.to_numpy()]
                own = np.repeat(blocks["list"].to_numpy(), pc.list_value_length(blocks["keys"]).to_numpy())[order.to_numpy()]
                for i in range(0, asked.num_rows, TILE):
                    part = asked.slice(i, TILE)
                    scores = np.round(np.stack([np.frombuffer(u.as_py()) for u in part["q_unit"]]) @ unit.T, DIGITS)
                    rows, ats = [], []
                    for row, (s, lists) in enumerate(zip(scores, part["lists"].to_pylist())):
                        hits = np.arange(len(s)) if lists is None else np.flatnonzero(np.isin(own, lists))
                        if len(hits) > k:
                            hits = hits[s[hits] >= -np.partition(-s[hits], k - 1)[k - 1]]
                        hits = hits[np.argsort(-s[hits], kind="stable")][:k]
                        rows.append(np.full(len(hits), row))
                        ats.append(hits)
                    row, at = np.concatenate(rows), np.concatenate(ats)
                    out.append(pa.table([part["q"].take(pa.array(row)), keys.take(pa.array(at)), pa.array(scores[row, at])], names=["q", key, "score"]))
            return pa.concat_tables(out)

        found = left.groupBy("slice", "turn").cogroup(right.groupBy("slice", "turn")).applyInArrow(best, f"q {q_type}, `{key}` {k_type}, score double")
        return self._ranked(found, k, key)
