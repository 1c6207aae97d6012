"""Continuous indexing: event lines, liveness, upserts by micro-batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftwood.operators.scans import Scan
from driftwood.operators.store import upsert

#: Fields of all kinds of events; a kind fills its own.
EVENT = "type string, path string, doc_id string, text string, total long, done long, error string"


def events(lines: DataFrame, column: str = "value") -> DataFrame:
    """Typed events from lines of JSON; a line that is none, or has no type, is an event of type malformed."""
    parsed = lines.select(F.from_json(column, EVENT).alias("e"), F.col(column).alias("line"))
    kind = F.coalesce(F.col("e.type"), F.when(F.col("e.error").isNotNull(), "error"), F.lit("malformed"))
    return parsed.select(kind.alias("type"), *[F.col(f"e.{c}") for c in ("path", "doc_id", "text", "total", "done", "error")])


def sessions(beats: DataFrame, key: str, time: str, gap: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """Times a worker was alive: heartbeats no further apart than `gap`; works on streams (with a watermark) and batches."""
    windows = F.session_window(time, gap).alias("session")
    if beats.isStreaming:
        beats = beats.withWatermark(time, late)
    return beats.groupBy(key, windows).agg(F.count("*").alias("n")).select(key, F.col("session.start").alias("began"), F.col("session.end").alias("ended"), "n")


def alive(beats: DataFrame, key: str, time: str, seconds: float, order: list[str] | None = None) -> DataFrame:
    """(key, began, ended, n) of each stretch of heartbeats no further apart than `seconds`, of a table of past beats.

    A key's beats are read in ranges of time, so one of very many beats is many tasks' work.  Beats without a time come
    first and are stretches of their own; a null key is a key.
    """
    scan = Scan(beats.select(key, time, *(order or [])), [key], [time, *(order or [])]).previous(beat_before=F.col(time))
    gap = F.col(time).cast("double") - F.col("beat_before").cast("double")
    scan.running(stretch=("sum", F.when(gap <= seconds, 0).otherwise(1)))
    return scan.result().groupBy(key, "stretch").agg(F.min(time).alias("began"), F.max(time).alias("ended"), F.count("*").alias("n")).drop("stretch")


def connected(last_seen: Column, now: Column, seconds: int = 30) -> Column:
    return (now.cast("double") - last_seen.cast("double")) < seconds


def index_stream(chunks: DataFrame, folder: str, checkpoint: str, key: str, version: list[str]) -> StreamingQuery:
    """Upsert a stream of chunks into a folder of numbered versions, one per micro-batch; the latest is the store.

    A batch that is run again writes its number again, so a restart leaves no double.
    """
    spark = chunks.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        new = upsert(batch.limit(0), batch, key, version)
        if number:
            new = upsert(spark.read.schema(batch.schema).parquet(f"{folder}/{number - 1}"), new, key, version)
        new.write.mode("overwrite").parquet(f"{folder}/{number}")

    return chunks.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
