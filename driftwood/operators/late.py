"""Compressed late interaction: token vectors as the number of a centroid and a residual of a few bits a component.

An index holds, by centroid, the keys with a token there, and by key its tokens' centroids and residuals.  A search goes
in three steps: keys under the centroids nearest to each query vector are candidates, scored by these centroids alone;
the best are scored by their tokens as the codes give them back; of the best of these the true vectors decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwood.operators.ann import SAMPLE, _sound, centres, nearest
from driftwood.operators.query_sets import late_scores_each
from driftwood.operators.staging import staged

#: Rows of the sample per centroid at least, centroids at most, and bits of a component's residual.
PER_CENTROID, CENTROIDS, BITS = 4, 4_096, 4
#: Keys in a row of a centroid's list.
LISTED = 4_096
#: Candidates by centroids, and by codes, for each hit wanted.
NEAR, CLOSE = 16, 4


class Codec:
    """Centroids and the levels of residuals."""

    def __init__(self, means: np.ndarray, cuts: np.ndarray, levels: np.ndarray):
        self.means, self.cuts, self.levels = means, cuts, levels

    @property
    def width(self) -> int:
        return self.means.shape[1]

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centroid of each vector and its residual, two components a byte."""
        own = nearest(vectors, self.means)
        code = np.searchsorted(self.cuts, vectors - self.means[own]).astype(np.uint8)
        code = np.pad(code, ((0, 0), (0, code.shape[1] % 2)))
        return own, code[:, ::2] << 4 | code[:, 1::2]

    def decode(self, own: np.ndarray, packed: np.ndarray) -> np.ndarray:
        code = np.stack([packed >> 4, packed & 15], axis=2).reshape(len(packed), -1)[:, : self.width]
        return self.means[own] + self.levels[code]


def fit(tokens: DataFrame, vector: str, centroids: int | None = None, sample: int = SAMPLE) -> Codec:
    """A codec from at most `sample` vectors, those of the smallest hashes; most of them say how wide vectors are."""
    rows = tokens.where(_sound(vector)).select(vector).orderBy(F.xxhash64(vector), vector).limit(sample).toPandas()[vector]
    width = max(((n, w) for w, n in rows.map(len).value_counts().items()), default=(0, 1))[1]
    points = np.array([v for v in rows if len(v) == width], np.float64).reshape(-1, width)
    if not len(points):
        return Codec(np.zeros((1, 1)), np.zeros(0), np.zeros(1))
    # sixteen times the root of the number of vectors, where the sample has enough for them
    means = centres(points, centroids or max(1, min(CENTROIDS, len(points) // PER_CENTROID, round(16 * tokens.count() ** 0.5))))
    rest = np.sort((points - means[nearest(points, means)]).ravel())
    parts = np.array_split(rest, min(1 << BITS, len(rest)))
    return Codec(means, np.array([p[0] for p in parts[1:]]), np.array([p.mean() for p in parts]))


def build(tokens: DataFrame, folder: str, key: str = "chunk_id", vector: str = "vec", centroids: int | None = None) -> None:
    """Writes an index of (key, vector) rows to a folder that does not exist yet.

    A key's vectors are those of one text chunk and are packed as one row; rows without a key, and unsound vectors or
    ones of another width than most, are left out; equal vectors of a key count once or twice alike.
    """
    spark = tokens.sparkSession
    codec = fit(tokens, vector, centroids)
    facts = [("mean", k, m.tolist()) for k, m in enumerate(codec.means)] + [("cuts", 0, codec.cuts.tolist()), ("levels", 0, codec.levels.tolist())]
    spark.createDataFrame(facts, "kind string, n int, x array<double>").coalesce(1).write.parquet(f"{folder}/codec")
    kind = tokens.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, code = codec.encode(batch["v"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, codec.width))
            yield pa.RecordBatch.from_arrays([batch["k"], pa.array(own, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary())], names=["k", "centroid", "code"])

    sound = tokens.where(_sound(vector) & (F.size(f"`{vector}`") == codec.width)).select(F.col(f"`{key}`").alias("k"), F.col(f"`{vector}`").alias("v")).where("k is not null")
    coded = staged(sound.mapInArrow(encode, f"k {kind}, centroid int, code binary"), "coded")
    packed = coded.groupBy("k").agg(F.collect_list(F.struct("centroid", "code")).alias("t"))
    packed = packed.select("k", F.transform("t", lambda x: x["centroid"]).alias("centroids"), F.transform("t", lambda x: x["code"]).alias("codes"))
    packed.write.option("compression", "zstd").parquet(f"{folder}/keys")
    held = coded.select("centroid", "k").distinct()
    size = F.broadcast(held.groupBy("centroid").agg(F.ceil(F.count("*") / LISTED).cast("int").alias("rows")))  # a row a centroid
    lists = held.join(size, "centroid").groupBy("centroid", F.pmod(F.xxhash64("k"), F.col("rows")).alias("row")).agg(F.sort_array(F.collect_list("k")).alias("ks"))
    lists.select("centroid", "ks").repartition("centroid").sortWithinPartitions("centroid").write.option("compression", "zstd").option("parquet.writer.version", "v2").parquet(f"{folder}/lists")


class Index:
    """An index that build() has written."""

    def __init__(self, spark: SparkSession, folder: str):
        facts = spark.read.parquet(f"{folder}/codec").orderBy("kind", "n").collect()
        of = lambda kind: np.array([r.x for r in facts if r.kind == kind])
        self.codec = Codec(of("mean"), of("cuts")[0], of("levels")[0])
        self.keys, self.lists = spark.read.parquet(f"{folder}/keys"), spark.read.parquet(f"{folder}/lists")

    def bytes_per_vector(self) -> float:
        """Bytes of codes and centroid numbers; a row's own are besides."""
        return (self.codec.width + 1) // 2 + 2 * (1 if len(self.codec.means) <= 1 << 16 else 2)

    def candidates(self, queries: DataFrame, n: int, probes: int) -> DataFrame:
        """(q, k): each query's n keys of the greatest sum over its vectors of the best probed centroid that the key is under."""
        codec = self.codec
        q_type = queries.schema["q"].dataType.simpleString()

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                scores = batch["q_vec"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, codec.width) @ codec.means.T
                best = np.argsort(-scores, axis=1, kind="stable")[:, :probes]
                times = best.shape[1]
                rows = np.repeat(np.arange(batch.num_rows), times)
                # above 0, so that a vector with no probed centroid at a key adds less than any that has one
                above = np.take_along_axis(scores, best, axis=1) - scores.min(axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays([batch["q"].take(pa.array(rows)), batch["part"].take(pa.array(rows)), pa.array(best.ravel(), pa.int32()), pa.array(above.ravel())], names=["q", "part", "centroid", "s"])

        asked = queries.where(_sound("q_vec") & (F.size("q_vec") == codec.width)).select("q", F.monotonically_increasing_id().alias("part"), "q_vec")
        probed = staged(asked.mapInArrow(near, f"q {q_type}, part long, centroid int, s double"), "probed")
        met = self.lists.join(probed, "centroid").select("q", "part", "s", F.explode("ks").alias("k"))
        scored = met.groupBy("q", "k", "part").agg(F.max("s").alias("s")).groupBy("q", "k").agg(F.sum("s").alias("s"))
        return scored.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "k"))).where(F.col("n") <= n).select("q", "k")

    def close(self, queries: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
        """(q, k): of the pairs each query's n of greatest MaxSim by the codes."""
        codec = self.codec
        asked = queries.where(_sound("q_vec") & (F.size("q_vec") == codec.width)).groupBy("q").agg(F.collect_list("q_vec").alias("q_vecs"))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for vecs, own, codes in zip(batch["q_vecs"], batch["centroids"], batch["codes"]):
                    a = vecs.values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, codec.width)
                    packed = np.frombuffer(b"".join(codes.as_py()), np.uint8).reshape(len(own), -1)
                    out.append(float((a @ codec.decode(own.values.to_numpy(), packed).T).max(axis=1).sum()))
                yield pa.RecordBatch.from_arrays([batch["q"], batch["k"], pa.array(out, pa.float64())], names=["q", "k", "s"])

        met = pairs.join(self.keys, "k").join(asked, "q")
        kinds = [f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("q", "k")]
        scored = met.select("q", "k", "q_vecs", "centroids", "codes").mapInArrow(score, ", ".join([*kinds, "s double"]))
        return scored.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "k"))).where(F.col("n") <= n).select("q", "k")

    def search(self, queries: DataFrame, tokens: DataFrame, k: int, key: str = "chunk_id", vector: str = "vec", probes: int = 16) -> DataFrame:
        """(q, key, score, rank): each query's k keys of greatest MaxSim among those the codes put first, by the true vectors.

        `queries` (q, q_vec) has a row per vector; unsound ones are left out.  `tokens` are the rows the index was built of.
        """
        near = staged(self.candidates(queries, NEAR * k, probes), "near")
        close = staged(self.close(queries, near, CLOSE * k), "close").withColumnRenamed("k", key)
        sound = lambda df, c: df.where(_sound(c) & (F.size(c) == self.codec.width))
        scored = late_scores_each(close, sound(queries, "q_vec"), sound(tokens.select(key, F.col(f"`{vector}`").alias("vec")), "vec"), key)
        ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), key)) - 1)
        return ranked.where(F.col("rank") < k)
