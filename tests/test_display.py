"""Small expressions by hand-made cases: progress, time, bars, tails, stamps, liveness, catalogue, batches, vocabulary."""

import datetime
import hashlib

from pyspark.sql import functions as F

from driftwood.functions import columns as C
from driftwood.functions import display
from driftwood.operators import store
from driftwood.streaming import indexing


def each(spark, rows, schema, column):
    return [r.r for r in spark.createDataFrame(rows, schema).coalesce(1).select(column.alias("r")).collect()]


def test_progress_and_time(spark):
    assert each(spark, [(1, 8), (3, 8), (0, 5), (5, 5), (3, 0), (1, None), (1, 200), (3, 200)], "d long, n long", display.percent_done(F.col("d"), F.col("n"))) == [12, 38, 0, 100, 0, 0, 0, 2]
    assert each(spark, [(None,), (0,), (59,), (60,), (125,), (3600,), (4210,), (90000,)], "s long", display.remaining(F.col("s"))) == ["–", "–", "59s", "1m", "2m 5s", "1h", "1h 10m", "25h"]


def test_bars_badges_and_tails(spark):
    got = each(spark, [(10,), (50,), (55,), (80,), (250,)], "p long", F.struct(display.bar(F.col("p"), "cpu").alias("c"), display.bar(F.col("p"), "ram").alias("m")))
    assert [(r.c.width, r.c.level, r.m.level) for r in got] == [(10, "ok", "ok"), (50, "warn", "ok"), (55, "warn", "warn"), (80, "critical", "critical"), (100, "critical", "critical")]
    assert each(spark, [("pdf", 0.5, list("abcdefg"))], "t string, s double, k array<string>", display.badges(F.col("t"), F.col("s"), F.col("k"))) == [["PDF", "score 0.5000", *"abcde"]]
    lines = [str(k) for k in range(70)]
    assert each(spark, [(lines,), (lines[:50],), (lines[:3],), ([],)], "l array<string>", display.log_tail(F.col("l"))) == [lines[20:], lines[:50], lines[:3], []]


def test_stamps_and_ids(spark):
    when = datetime.datetime(2024, 5, 6, 7, 8, 9, 123456, tzinfo=datetime.timezone.utc)
    assert each(spark, [(when, 42)], "t timestamp, n long", C.stamp_hash(F.col("t"), F.col("n"))) == [f"{when.timestamp():.3f}_42"]
    assert each(spark, [("/a/é.pdf",)], "p string", C.path_id(F.col("p"))) == [hashlib.md5("/a/é.pdf".encode()).hexdigest()]
    assert each(spark, [("a b/é&",)], "p string", C.percent_encoded(F.col("p"))) == ["a%20b%2F%C3%A9%26"]


def test_connected(spark):
    times = lambda s: datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(seconds=s)
    rows = [(times(0), times(29)), (times(0), times(30)), (times(0), times(0)), (None, times(0))]
    assert each(spark, rows, "seen timestamp, now timestamp", indexing.connected(F.col("seen"), F.col("now"))) == [True, False, True, None]


def test_catalogue_and_batches(spark):
    rows = [("b", "Zed", 0), ("b", "later", 1), ("a", "alpha", 0), ("c", None, 0), (None, "none", 0)]
    got = store.catalogue(spark.createDataFrame(rows, "doc string, title string, i int"), "doc", "title", "i").collect()
    assert [(r.doc, r.title, r.n_chunks) for r in got] == [("c", "?", 1), ("a", "alpha", 1), (None, "none", 1), ("b", "Zed", 2)]
    chunks = spark.createDataFrame([(1, 0, "p", 1), (1, 1, "p", 2), (1, 0, "q", 3), (2, 5, "r", 1), (2, None, "s", 0)], "b int, i int, path string, n int")
    assert sorted(map(tuple, store.batch_report(chunks, "b", "i", "path", "n").collect())) == [(1, 3, 2, "q"), (2, 2, 0, "r")]


def test_keywords_of_token_ids(spark):
    weights = spark.createDataFrame([(1, 10, 3.0), (1, 11, 2.0), (1, 12, 9.0), (1, 99, 50.0), (1, 13, 1.0)], "doc long, token long, weight double")
    vocabulary = spark.createDataFrame([(10, "▁river"), (11, "##River"), (12, "the"), (13, "Silt")], "token long, text string")
    rows = store.shown_keywords(store.decoded(weights, vocabulary), "doc", "text", "weight").orderBy("rank").collect()
    assert [r.text for r in rows] == ["river", "Silt"]
