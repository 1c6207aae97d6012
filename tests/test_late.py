"""Compressed late interaction against MaxSim of all vectors: recall, what codes give back, odd vectors, no rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwood.operators import late, query_sets


@pytest.fixture(scope="module")
def tokens(spark):
    rng = np.random.default_rng(6)
    topics = rng.normal(size=(25, 3, 16))
    rows = [(k, (topics[k % 25, j % 3] + rng.normal(size=16) * 0.5).tolist(), "clash") for k in range(400) for j in range(5)]
    rows += [rows[0], (None, [1.0] * 16, "c"), (900, None, "c"), (901, [float("nan")] * 16, "c"), (902, [1.0], "c")]
    return spark.createDataFrame(rows, "chunk_id long, vec array<double>, k string").repartition(3)


@pytest.fixture(scope="module")
def index(spark, tokens, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("late") / "index")
    late.build(tokens, folder)
    return late.Index(spark, folder)


def asked(tokens):
    return tokens.where("chunk_id % 20 = 0 and chunk_id < 900").select(F.col("chunk_id").alias("q"), F.col("vec").alias("q_vec"))


def test_recall(tokens, index):
    sound = tokens.where("chunk_id < 900")
    exact = query_sets.late_each(asked(tokens), sound, 10).collect()
    got = index.search(asked(tokens), tokens, 10).collect()
    true = {(r.q, r.chunk_id): r.score for r in exact}
    found = {(r.q, r.chunk_id): r.score for r in got}
    assert len(true.keys() & found.keys()) >= 0.9 * len(true)
    assert all(abs(found[p] - true[p]) < 1e-5 for p in true.keys() & found.keys())
    assert index.bytes_per_vector() <= 10


def test_codes_give_vectors_back(index):
    rng = np.random.default_rng(2)
    points = index.codec.means[rng.integers(0, len(index.codec.means), 200)] + rng.normal(size=(200, 16)) * 0.3
    own, code = index.codec.encode(points)
    off = np.linalg.norm(index.codec.decode(own, code) - points, axis=1)
    assert off.mean() < np.linalg.norm(index.codec.means[own] - points, axis=1).mean() / 3


def test_odd_queries_and_no_rows(spark, tokens, index, tmp_path):
    odd = spark.createDataFrame([(1, None), (2, [1.0]), (3, [float("nan")] * 16)], "q long, q_vec array<double>")
    assert index.search(odd, tokens, 3).collect() == []
    late.build(tokens.limit(0), str(tmp_path / "none"))
    assert late.Index(spark, str(tmp_path / "none")).search(odd, tokens, 3).collect() == []
