"""The inverted file with product codes against the exact search: recall, all lists, pruned lists, odd vectors."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwood.operators import ann, query_sets


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(4)
    middles = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(20)]
    rows = [(k, [x + rng.gauss(0, 0.4) for x in rng.choice(middles)], "clash") for k in range(3000)]
    rows += [rows[0], rows[1], (5000, None, "c"), (5001, [0.0] * 16, "c"), (5002, [float("nan")] * 16, "c"), (5003, [1.0] * 7, "c"), (5004, [None] + [1.0] * 15, "c"), (5005, [], "c")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, list string").repartition(3)


@pytest.fixture(scope="module")
def index(spark, table, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("ann") / "index")
    ann.build(table, folder, "vec_id", "embedding")
    return ann.Index(spark, folder)


@pytest.fixture(scope="module")
def queries(table):
    return table.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("q_vec")).distinct()


def hits(df):
    return {(r.q, r.vec_id) for r in df.select("q", "vec_id").collect()}


def test_recall_and_scores(table, index, queries):
    sound = table.where("size(embedding) = 16 and vec_id < 5000")
    exact = query_sets.dense_each(queries.where("q < 5000"), sound, 20, "vec_id", "embedding").cache()
    got = index.search(queries, 20, key="vec_id").cache()
    assert index.model.probes(ann.RECALL) < len(index.model.lists)
    assert len(hits(got) & hits(exact)) / len(hits(exact)) >= 0.9
    true = {(r.q, r.vec_id): r.score for r in exact.collect()}
    assert all(abs(true.get((r.q, r.vec_id), r.score) - r.score) < 1e-8 for r in got.collect())
    whole = index.search(queries, 20, probes=len(index.model.lists), rerank=0, key="vec_id")
    assert sorted(map(tuple, whole.select("q", "vec_id", "score", "rank").collect())) == sorted(map(tuple, exact.select("q", "vec_id", "score", "rank").collect()))


def test_every_row_is_in_one_list(table, index):
    keys = [k for r in index.blocks.select("keys").collect() for k in r["keys"]]
    assert sorted(keys) == sorted([*range(3000), 0, 1])


def test_only_probed_lists_are_read(index, queries):
    few = queries.orderBy("q").limit(2)
    plan = index.search(few, 5, probes=2, key="vec_id")._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan or "list#" in plan.split("PartitionFilters")[1][:80]
    probed = {r["list"] for r in index.probed(few, 2).collect()}
    assert 0 < len(probed) <= 4 < len(index.model.lists)


def test_odd_queries_and_empty_tables(spark, table, index, tmp_path):
    odd = spark.createDataFrame([(1, None), (2, [0.0] * 16), (3, [1.0])], "q long, q_vec array<float>")
    assert index.search(odd, 5, key="vec_id").collect() == []
    ann.build(table.limit(0), str(tmp_path / "none"), "vec_id", "embedding")
    none = ann.Index(spark, str(tmp_path / "none"))
    assert none.search(odd, 5, key="vec_id").collect() == []
    ann.build(table.where("vec_id = 7"), str(tmp_path / "one"), "vec_id", "embedding")
    one = ann.Index(spark, str(tmp_path / "one")).search(table.where("vec_id = 7").select(F.col("vec_id").alias("q"), F.col("embedding").alias("q_vec")), 5, key="vec_id").collect()
    assert [(r.vec_id, r.score, r["rank"]) for r in one] == [(7, 1.0, 0)]


def test_codes_stay_close(table, index):
    rows = table.where("vec_id < 200").select("embedding").collect()
    points = ann.units(np.array([r.embedding for r in rows]))
    own, codes = index.model.encode(points)
    back = np.stack([index.model.decode(int(c), code[None])[0] for c, code in zip(own, codes)])
    assert np.linalg.norm(points - back, axis=1).mean() < np.linalg.norm(points - index.model.lists[own], axis=1).mean() / 2
