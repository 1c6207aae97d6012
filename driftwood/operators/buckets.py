"""A chunk store in buckets by a hash of the document; an update rewrites the buckets it touches and no other.

Buckets are partitions of a Parquet table, overwritten dynamically.  How many there are is fixed when a store is made;
`grown` makes a store of more from one whose buckets have become large, so that what a small update writes stays small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwood.operators.staging import staged

#: Bytes that a bucket should not pass, about.
BUCKET_BYTES = 64 << 20


class BucketStore:
    """Rows of documents below a folder: `key` names the document; every other column is the rows' own."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "doc_id", buckets: int = 64):
        self.spark, self.folder, self.key, self.n = spark, folder, key, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(f"`{self.key}`")), F.lit(self.n)).cast("int")

    def _raw(self, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.folder)

    def create(self, rows: DataFrame) -> BucketStore:
        """Writes the first rows; each bucket gets a row without content that keeps its place when it has no document."""
        marks = self.spark.range(self.n).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema], F.lit(True).alias("mark"), F.col("id").cast("int").alias("bucket"))
        both = rows.withColumn("mark", F.lit(False)).withColumn("bucket", self._bucket()).unionByName(marks)
        both.repartition("bucket").write.option("compression", "zstd").partitionBy("bucket").parquet(self.folder)
        return self

    def read(self) -> DataFrame:
        """The stored rows."""
        return self.spark.read.parquet(self.folder).where("not mark").drop("mark", "bucket")

    def replace(self, new: DataFrame, gone: DataFrame | None = None) -> list[int]:
        """All rows of the documents in `new`, and of those in `gone`, give way to `new`; returns the buckets written.

        `new` has the store's columns.  A null key is a document like others.  Running it again changes nothing.
        """
        new = staged(new.withColumn("bucket", self._bucket()), "new")
        touched = new.select(self.key, "bucket")
        if gone is not None:
            touched = touched.unionByName(gone.select(self.key).withColumn("bucket", self._bucket()))
        touched = staged(touched.distinct(), "touched")
        buckets = sorted(r.bucket for r in touched.select("bucket").distinct().collect())  # not more than there are
        if not buckets:
            return []
        stored = self.spark.read.parquet(self.folder).where(F.col("bucket").isin(buckets)).alias("s")
        same = F.col(f"s.`{self.key}`").eqNullSafe(F.col(f"t.`{self.key}`")) & ~F.col("s.mark")
        left = stored.join(touched.select(self.key).alias("t"), same, "left_anti")
        merged = staged(left.unionByName(new.withColumn("mark", F.lit(False))), "merged")
        out = merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
        out.partitionBy("bucket").parquet(self.folder)
        return buckets

    def grown(self, folder: str, buckets: int) -> BucketStore:
        """The same rows in a store of another number of buckets."""
        return BucketStore(self.spark, folder, self.key, buckets).create(self.read())
