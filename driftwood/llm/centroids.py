"""Centroid clustering in exact integers: dot products are kept per vector and changed only where a centroid changed.

Vectors become integers, so a squared distance |v|^2 - 2 v.c + |c|^2 is exact.  A table holds each vector with its dot
products to all centroids.  After a round each centroid differs from the last one in some components; the products
change by v[j] times that difference for those components j alone, and the nearest centroid is chosen anew from them.
Only the centroids (k times the number of components) pass through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwood.llm.exchange import staged

#: A component's largest size as an integer: squared distances of 64 components and their products stay below 2**63.
LARGEST = 1 << 27
#: Vectors worked on at once.
ROWS = 8192


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component x, as double; an error for one that is too large."""
    product = lambda x: F.lit(float(scale)) * x.cast("double")
    too_large = F.raise_error(F.lit(f"a component is beyond {LARGEST} as an integer")).cast("int")
    return F.transform(vector, lambda x: F.when(F.abs(product(x)) <= LARGEST, F.floor(product(x)).cast("int")).otherwise(too_large))


def seeds(points: DataFrame, k: int) -> np.ndarray:
    """The vectors of the k smallest SHA-256 of `1:<id>`, in that order; equal hashes go by the components, null ids don't count."""
    order = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    rows = points.where("id is not null").select(order.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _assigned(before: np.ndarray | None, now: np.ndarray):
    """Adds to each row its dot products with the centroids `now`, changed from those with `before` or made new, and the nearest one."""
    k, width = now.shape
    changed = [(c, np.flatnonzero(now[c] != before[c])) for c in range(k)] if before is not None else []
    changed = [(c, at, now[c, at] - before[c, at]) for c, at in changed if len(at)]
    size = (now * now).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for first in range(0, whole_batch.num_rows, ROWS):
                batch = whole_batch.slice(first, ROWS)
                n, v = batch.num_rows, _matrix(batch["v"], width)
                if before is None:
                    dots = v @ now.T
                else:
                    dots = _matrix(batch["dots"], k)
                    for c, at, by in changed:
                        dots[:, c] += v[:, at] @ by
                far = size - 2 * dots
                cluster = far.argmin(axis=1)
                distance = far[np.arange(n), cluster] + (v * v).sum(axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(dots.ravel()))
                yield pa.RecordBatch.from_arrays([batch["id"], batch["v"], lists, pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=["id", "v", "dots", "cluster", "distance"])

    return run


def _means(points: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid's vectors' componentwise floor(sum / count); without vectors it stays."""
    width = centroids.shape[1]
    sums = points.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col("v")[j].cast("decimal(20)")).alias(f"s{j}") for j in range(width)])
    out = centroids.copy()
    for r in sums.collect():
        out[r.cluster] = [int(r[f"s{j}"]) // r.n for j in range(width)]
    return out


def cluster(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row per kept vector.

    Kept are vectors of exactly `width` components, none of them null, infinite or no number; the others are no rows of
    the result.  Components become floor(scale * x); one beyond `LARGEST` raises an error, as its square would not be
    exact.  Centroids start as the k kept vectors of the smallest SHA-256 of `1:<id>` (fewer vectors: fewer centroids),
    are replaced `rounds` times by the floored means of their vectors, and vectors are assigned once more; of equally
    near ones the smaller number counts, and a centroid without vectors stays.  Rows that repeat an id or a vector are
    rows of their own; a row with a null id is kept but starts no centroid.  Other columns are ignored.  An empty table,
    or one where nothing can start a centroid, gives no rows.
    """
    v = F.col(f"`{column}`")
    sound = (F.size(v) == width) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.where(F.coalesce(sound, F.lit(False))).select(F.col(f"`{key}`").cast("long").alias("id"), whole(v, scale).alias("v"))
    schema = "id long, v array<int>, dots array<bigint>, cluster int, distance long"
    now = seeds(kept, k)
    if not len(now):
        points = kept.sparkSession.createDataFrame([], schema)
        now = np.zeros((1, width), np.int64)
    else:
        points = staged(kept.mapInArrow(_assigned(None, now), schema), "round0")
        for r in range(rounds):
            before, now = now, _means(points, now)
            points = staged(points.mapInArrow(_assigned(before, now), schema), f"round{r + 1}")
    # k rows
    sums = points.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38)")).alias("s")).collect()
    of = {r.cluster: int(r.s) for r in sums}
    inertia = F.array(*[F.lit(of.get(c, 0)).cast("long") for c in range(len(now))])
    digests = F.array(*[F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in now.tolist()])
    at = F.col("cluster")
    return points.select(F.col("id").alias("vec_id"), "cluster", "distance", inertia[at].alias("cluster_inertia"), F.lit(sum(of.values())).cast("long").alias("inertia"), digests[at].alias("centroid_sha256"))
