"""Searches of all rows of the probed lists: slices and turns, ties of copies, what is broadcast, and the sample."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwood.operators import ann, query_sets


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(9)
    rows = [(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(900)]
    # a third are copies of one vector
    rows = [(k, rows[0][1] if k % 3 == 0 else v) for k, v in rows]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)


@pytest.fixture(scope="module")
def index(spark, table, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("ann") / "index")
    ann.build(table, folder, "vec_id", "embedding")
    return ann.Index(spark, folder)


def test_slices_and_turns(spark, table, index, monkeypatch):
    queries = table.where("vec_id % 7 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("q_vec"))
    exact = query_sets.dense_each(queries, table, 12, "vec_id", "embedding")
    want = sorted(map(tuple, exact.select("q", "vec_id", "score", "rank").collect()))
    for slice_, turn, tile in ((16_384, 16_384, 128), (100, 30, 7)):
        monkeypatch.setattr(ann, "SLICE", slice_)
        monkeypatch.setattr(ann, "TURN", turn)
        monkeypatch.setattr(ann, "TILE", tile)
        got = index.search(queries, 12, probes=len(index.model.lists), rerank=0, key="vec_id")
        assert sorted(map(tuple, got.select("q", "vec_id", "score", "rank").collect())) == want
        some = index.search(queries, 12, probes=2, rerank=0, key="vec_id").collect()
        lists = {(r.q, r.list) for r in index.probed(queries, 2).collect()}
        at = {k: r.list for r in index.blocks.select("list", "keys").collect() for k in r["keys"]}
        assert some and all((r.q, at[r.vec_id]) in lists for r in some)


def test_no_more_than_k_rows_a_query_and_slice_and_no_broadcast(table, index):
    queries = table.where("vec_id % 3 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("q_vec"))
    got = index.search(queries, 5, probes=len(index.model.lists), rerank=0, key="vec_id")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "FlatMapCoGroupsInArrow" in plan
    assert {r.q: r["count"] for r in got.groupBy("q").count().collect()} == {r.q: 5 for r in queries.collect()}


def test_sample(table):
    rows = table.select("embedding", F.xxhash64("vec_id").alias("h")).orderBy("h").collect()
    for sample in (100, 899, 5000):
        got = ann._smallest(table, 900, "vec_id", "embedding", sample)
        assert np.allclose(np.array(got.to_pylist()), np.array([r.embedding for r in rows[:sample]]))
    # where keys repeat, the hashes' share may hold too few
    same = table.withColumn("vec_id", F.lit(1))
    assert len(ann._smallest(same, 900, "vec_id", "embedding", 100)) == 100
