"""Scans over ranges against plain loops: hot keys that span ranges, null keys, ties, repeated rows, no rows."""

import random

from pyspark.sql import functions as F

from driftwood.operators.scans import PART, Scan


def plain(rows):
    out, state = [], {}
    for key, at, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] is not None, r[2] or 0)):
        total, bits, most, before = state.get(key, (0, 0, None, None))
        now = (total + (x or 0), bits ^ (x or 0), x if most is None else most if x is None else max(most, x), x)
        out.append((key, at, x, *now[:3], before))
        state[key] = now
    return out


def made():
    rng = random.Random(3)
    rows = [(rng.choice([7, 7, 7, 1, 2, None]), rng.choice([None, *range(400)]), rng.randint(-9, 9)) for _ in range(2000)]
    return rows + rows[:40] + [(5, 1, None), (5, None, 3)]


def scanned(df):
    scan = Scan(df, ["scan key"], ["at", "x"]).running(total=("sum", F.col("x")), bits=("bit_xor", F.col("x")), most=("max", F.col("x"))).previous(before=F.col("x"))
    return scan.result()


def test_running_and_previous(spark):
    rows = made()
    df = spark.createDataFrame(rows, "`scan key` long, at long, x long").repartition(5)
    got = sorted(map(tuple, scanned(df).collect()), key=repr)
    assert got == sorted(plain(rows), key=repr)


def test_a_hot_key_spans_ranges(spark):
    df = spark.createDataFrame(made(), "key long, at long, x long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        scan = Scan(df, ["key"], ["at", "x"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert scan.rows.where("key = 7").select(PART).distinct().count() > 1
    got = scan.running(n=("sum", F.lit(1))).result().where("key = 7").select("n").collect()
    assert sorted(r.n for r in got) == list(range(1, len(got) + 1))


def test_identical_rows_only(spark):
    df = spark.range(3000).select(F.lit(1).alias("key"), F.lit(2).alias("at"), F.lit(3).alias("x"))
    rows = Scan(df, ["key"], ["at"]).running(n=("sum", F.lit(1)), total=("sum", F.col("x"))).result().collect()
    assert sorted(r.n for r in rows) == list(range(1, 3001)) and max(r.total for r in rows) == 9000


def test_no_rows(spark):
    df = spark.createDataFrame([], "`scan key` long, at long, x long")
    assert scanned(df).collect() == []
