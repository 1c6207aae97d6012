"""Continuous indexing: event lines as they come, only what is not stored yet, bad rows aside, counts as they pass."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from driftwood.operators.buckets import BucketStore
from driftwood.operators.chunking import hybrid
from driftwood.operators.indexing import changed, filled, numbered
from driftwood.operators.staging import staged

#: Name of the counts that a run reports.
METRICS = "driftwood_events"
_FIELDS = "type string, path string, doc_id string, text string, file_hash string, error string"
#: Columns of the stored chunks.
CHUNK = "doc_id string, file_hash string, chunk_idx int, chunk_total long, chunk_id string, uuid string, content string"


def typed(lines: DataFrame) -> DataFrame:
    """Events of lines of JSON (value): type, path, doc_id, text, file_hash, error, and the line.

    A line that is no JSON, or has no type, is of type malformed, or of type error if it tells one; so is a file without
    a doc_id.
    """
    parsed = lines.select(F.col("value").alias("line"), F.from_json("value", _FIELDS).alias("e"))
    kind = F.when((F.col("e.type") == "file") & F.col("e.doc_id").isNull(), "malformed").otherwise(F.coalesce("e.type", F.when(F.col("e.error").isNotNull(), "error"), F.lit("malformed")))
    return parsed.select(kind.alias("type"), *[F.col(f"e.{c}") for c in ("path", "doc_id", "text", "file_hash", "error")], "line")


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Typed events of the NDJSON files of a folder, some files a batch."""
    return typed(spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(folder))


def counts() -> list[Column]:
    """What a run counts of the events that pass: lines, files, bad ones, and those told to be skipped."""
    of = lambda name, *kinds: F.count_if(F.col("type").isin(*kinds)).alias(name)
    return [F.count("*").alias("lines"), of("files", "file"), of("bad", "malformed", "error"), of("skipped", "skip")]


class Counts(StreamingQueryListener):
    """Adds up the counts of all batches of the streams it hears: a listener for `spark.streams.addListener`."""

    def __init__(self) -> None:
        self.total: Counter = Counter()
        self.batches: set[tuple[str, int]] = set()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        row = event.progress.observedMetrics.get(METRICS)
        batch = (str(event.progress.id), event.progress.batchId)
        if row is not None and event.progress.numInputRows and batch not in self.batches:
            self.batches.add(batch)
            self.total.update(row.asDict())

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def apply(events: DataFrame, store: BucketStore, bad_folder: str, number: int = 0) -> None:
    """Indexes a table of typed events: chunks of files that are not stored with their digest replace their documents'.

    Of several events of a document the one of the greatest line counts.  A text that is null or blank is the file's path.
    Bad events are written below `bad_folder`, under the number; the same number again writes the same.
    """
    events.where(F.col("type").isin("malformed", "error")).select("type", "error", "line").write.mode("overwrite").parquet(f"{bad_folder}/batch={number}")
    last = events.where("type = 'file'").groupBy("doc_id").agg(F.max(F.struct("line", "path", "text", "file_hash")).alias("x")).select("doc_id", "x.path", "x.text", "x.file_hash")
    fresh = staged(changed(last, store.read(), "doc_id", "file_hash"), "fresh")
    chunks = numbered(hybrid(filled(fresh, "path")), "doc_id", "chunk_index").drop("chunk_index").join(fresh.select("doc_id", "file_hash"), "doc_id")
    store.replace(chunks.select(*[f.split()[0] for f in CHUNK.split(", ")]), fresh)


def index_events(events: DataFrame, store: BucketStore, bad_folder: str) -> dict[str, int]:
    """apply() to a table of events; returns its counts."""
    seen = Observation(METRICS)
    apply(staged(events.observe(seen, *counts()), "events"), store, bad_folder)
    return dict(seen.get)


def index_event_stream(events: DataFrame, store: BucketStore, bad_folder: str, checkpoint: str) -> StreamingQuery:
    """apply() to each batch of a stream until its source has no more; a batch that is run again changes nothing.

    The counts of a batch reach listeners (see Counts) under `METRICS`.
    """
    observed = events.observe(METRICS, *counts())
    # a batch is read once, so that it is counted once
    return observed.writeStream.foreachBatch(lambda batch, number: apply(staged(batch, "batch"), store, bad_folder, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
