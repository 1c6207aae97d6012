"""Streams: liveness with timers over a restart, last values, a bucketed store, continuous indexing like a batch."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from driftwood.operators.buckets import BucketStore
from driftwood.streaming import continuous, liveness


@pytest.fixture(scope="module")
def state(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", liveness.PROVIDER)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def run(df, out, checkpoint, mode="append"):
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode).start().awaitTermination(180)


def test_stretches_end_after_silence_and_outlive_a_restart(state, tmp_path):
    source, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    schema = "worker string, t double"

    def go():
        beats = state.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source).select("worker", F.timestamp_seconds(F.col("t") + 1000).alias("ts"))
        run(liveness.stretches(beats, "worker", "ts", 30, "5 seconds"), out, ck)
        return sorted((r.worker, r.began.timestamp() - 1000, r.ended.timestamp() - 1000, r.n) for r in state.read.parquet(out).collect())

    put(state, source, [("a", 20.0), ("a", 0.0), ("b", 3.0), (None, 4.0), ("c", None)], schema)
    assert go() == []
    # the query starts again from its checkpoint: a's stretch goes on, b's has ended
    put(state, source, [("a", 45.0)], schema)
    assert go() == [("b", 3.0, 3.0, 1)]
    put(state, source, [("a", 200.0), ("a", 210.0), ("b", 205.0)], schema)
    assert go() == [("a", 0.0, 45.0, 3), ("b", 3.0, 3.0, 1)]
    put(state, source, [("z", 1000.0)], schema)
    assert go() == [("a", 0.0, 45.0, 3), ("a", 200.0, 210.0, 2), ("b", 3.0, 3.0, 1), ("b", 205.0, 205.0, 1)]


def test_last_values(state, tmp_path):
    source, ck = str(tmp_path / "in"), str(tmp_path / "ck")
    schema = "k string, v long, x string"
    seen = []

    def go():
        rows = state.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = liveness.last_values(rows, "k", "v", "x").writeStream.foreachBatch(lambda b, n: seen.extend(map(tuple, b.collect()))).outputMode("update")
        query.option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination(180)

    put(state, source, [("a", 1, "one"), ("a", 3, "three"), ("b", 1, None), (None, 9, "x"), ("c", None, "x")], schema)
    go()
    assert sorted(seen, key=repr) == [("a", 3, "three"), ("b", 1, None)]
    seen.clear()
    put(state, source, [("a", 2, "late"), ("b", 2, "two")], schema)
    go()
    assert seen == [("b", 2, "two")]


def sizes(folder):
    return {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_a_bucketed_store_rewrites_touched_buckets_alone(spark, tmp_path):
    rows = [(f"d{k}", i, f"text {k} {i}") for k in range(200) for i in range(3)] + [(None, 0, "of none")]
    schema = "doc_id string, mark_no int, content string"
    store = BucketStore(spark, str(tmp_path / "store"), buckets=16).create(spark.createDataFrame(rows, schema))
    before = sizes(tmp_path / "store")
    new = spark.createDataFrame([("d7", 0, "new"), ("x", 0, "added")], schema)
    gone = spark.createDataFrame([("d9",), (None,), ("d7",)], "doc_id string")
    written = store.replace(new, gone)
    want = sorted((r for r in rows if r[0] not in ("d7", "d9", None)), key=repr) + [("d7", 0, "new"), ("x", 0, "added")]
    assert sorted(map(tuple, store.read().collect()), key=repr) == sorted(want, key=repr)
    after = sizes(tmp_path / "store")
    same = {p for p in before if p in after and after[p] == before[p]}
    assert 0 < len(written) <= 4 and all(int(p.parent.name.split("=")[1]) not in written for p in same)
    assert {int(p.parent.name.split("=")[1]) for p in before} - {int(p.parent.name.split("=")[1]) for p in same} == set(written)
    assert store.replace(new, gone) == written and sorted(map(tuple, store.read().collect()), key=repr) == sorted(want, key=repr)
    # a bucket that loses all its documents is empty, and stays a bucket
    store.replace(new.limit(0), store.read().select("doc_id"))
    assert store.read().count() == 0 and store.replace(new.limit(0)) == []
    store.replace(new)
    assert store.grown(str(tmp_path / "more"), 50).read().count() == 2


def lines(seed):
    rng = random.Random(seed)
    out = []
    for k in range(60):
        doc = rng.randrange(25)
        out.append(json.dumps({"type": "file", "doc_id": f"d{doc}", "path": f"/p/{doc}", "text": None if doc == 3 else f"Text {doc}. " * 200, "file_hash": f"h{doc}"}))
    return [*out, "no json", '{"type":"file","path":"no id"}', '{"error":"disk"}', '{"type":"skip","doc_id":"d1"}', '{"type":"meta"}', ""]


def empty_store(spark, folder):
    return BucketStore(spark, folder, buckets=8).create(spark.createDataFrame([], continuous.CHUNK))


def test_a_stream_of_events_is_indexed_like_a_table(spark, tmp_path):
    all_lines = lines(1)
    for k in range(3):
        spark.createDataFrame([(x,) for x in all_lines[k::3]], "value string").coalesce(1).write.mode("append").text(str(tmp_path / "in"))
    table = spark.createDataFrame([(x,) for x in all_lines], "value string")
    batch = empty_store(spark, str(tmp_path / "batch"))
    counted = continuous.index_events(continuous.typed(table), batch, str(tmp_path / "bad_batch"))
    assert counted == {"lines": 66, "files": 60, "bad": 4, "skipped": 1}
    listener = continuous.Counts()
    spark.streams.addListener(listener)
    store = empty_store(spark, str(tmp_path / "store"))
    try:
        events = continuous.event_stream(spark, str(tmp_path / "in"), 1)
        continuous.index_event_stream(events, store, str(tmp_path / "bad"), str(tmp_path / "ck")).awaitTermination(300)
        got = sorted(map(tuple, store.read().collect()))
        assert got == sorted(map(tuple, batch.read().collect())) and len(got) > 25
        assert any(r[0] == "d3" and r[-1] == "/p/3" for r in got)
        assert sorted(r.line for r in spark.read.parquet(str(tmp_path / "bad")).collect()) == sorted(r.line for r in spark.read.parquet(str(tmp_path / "bad_batch")).collect())
        # the same batch again changes nothing
        continuous.apply(continuous.typed(table), store, str(tmp_path / "bad"), 7)
        assert sorted(map(tuple, store.read().collect())) == got
        for _ in range(50):
            if listener.total["lines"] >= 66:
                break
            time.sleep(0.2)
        assert dict(listener.total) == counted
    finally:
        spark.streams.removeListener(listener)
