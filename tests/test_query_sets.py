import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwood.operators import query_sets

RNG = np.random.default_rng(1)
VECTORS = [[float(x) for x in RNG.integers(-3, 4, 3)] for _ in range(60)]
TEXTS = [" ".join(RNG.choice(["silt", "delta", "Rivers", "the", "of", "clay9bed"], RNG.integers(0, 9))) for _ in range(60)]


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(k, f"d{k % 7}", t, v, "p") for k, (t, v) in enumerate(zip(TEXTS, VECTORS))] + [(60, "d1", None, None, "p"), (61, None, "", [0.0, 0.0, 0.0], "p")]
    return spark.createDataFrame(rows, "chunk_id long, doc string, text string, dense array<double>, rank string").repartition(3)


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(100, [1.0, 0.0, 0.0], ["silt", "of", "of"]), (101, [1.0, 2.0, -1.0], ["nowhere"]), (102, None, ["bed"]), (103, [0.0, 0.0, 0.0], None), (104, [1.0, 0.0, 0.0], ["delta", "clay"])], "q long, q_vec array<double>, words array<string>")


@pytest.mark.parametrize("sizes", [{}, {"block": 1, "slice_": 7}])
def test_dense_and_sparse_equal_brute_force_for_any_blocks(chunks, queries, sizes):
    got = {}
    for r in query_sets.dense_each(queries, chunks, 9, **sizes).orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append((r.chunk_id, r.score))
    assert set(got) == {100, 101, 104} and got[100] == got[104]
    for q, v in ((100, [1.0, 0.0, 0.0]), (101, [1.0, 2.0, -1.0])):
        want = [(-round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 9) + 0.0, k) for k, w in enumerate(VECTORS) if any(w)]
        assert [k for k, _ in got[q]] == [k for _, k in sorted(want)[:9]]
    found = {}
    for r in query_sets.sparse_each(queries, chunks, 100, **sizes).orderBy("q", "rank").collect():
        found.setdefault(r.q, []).append((r.chunk_id, r.score))
    words = [t.lower().replace("9", " ").split() for t in TEXTS]
    idf = {w: np.log(1 + (62 - n + 0.5) / (n + 0.5)) for w in ("silt", "of", "bed", "delta", "clay") for n in [sum(w in x for x in words)]}
    assert set(found) == {100, 102, 104}
    for q, asked in ((100, ["of", "silt"]), (102, ["bed"]), (104, ["clay", "delta"])):
        want = sorted((-round(sum(x.count(w) * idf[w] for w in asked), 9), k) for k, x in enumerate(words) if any(w in x for w in asked))
        assert [k for k, _ in found[q]] == [k for _, k in want] and np.allclose([s for _, s in found[q]], [-s for s, _ in want])


@pytest.mark.parametrize("sizes", [{}, {"block": 2, "slice_": 5}])
def test_late_interaction_equals_brute_force(spark, sizes):
    tokens = spark.createDataFrame([(k // 4, v) for k, v in enumerate(VECTORS)] + [(99, None)], "chunk_id long, vec array<double>")
    late = spark.createDataFrame([(q, VECTORS[q * 3 + k]) for q in range(4) for k in range(q + 1)], "q long, q_vec array<double>")
    got = {(r.q, r.chunk_id): r.score for r in query_sets.late_each(late, tokens, 100, **sizes).collect()}
    want = {(q, c): sum(max(np.dot(VECTORS[q * 3 + k], VECTORS[c * 4 + j]) for j in range(4)) for k in range(q + 1)) for q in range(4) for c in range(15)}
    assert got == pytest.approx(want)
    pairs = spark.createDataFrame([(1, 3), (1, 3), (2, 99), (3, 0)], "q long, chunk_id long")
    assert {(r.q, r.chunk_id): r.score for r in query_sets.late_scores_each(pairs, late, tokens).collect()} == pytest.approx({k: want[k] for k in ((1, 3), (3, 0))})


def test_results_have_payload_and_one_chunk_a_document(chunks, queries):
    rows = query_sets.search_each(queries, chunks, limit=4).collect()
    for q in (100, 101, 102, 104):
        mine = sorted((r for r in rows if r.q == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(len(mine))) and len({r.doc for r in mine}) == len(mine) and all(r.chunk_rank == "p" for r in mine)
    assert not [r for r in rows if r.q == 103]
    assert query_sets.search_each(queries, chunks.limit(0)).count() == 0
    assert query_sets.search_each(queries.limit(0), chunks).count() == 0


def test_reranked_results_keep_clashing_columns(chunks, queries):
    late = queries.where("q_vec is not null").select("q", "q_vec")
    tokens = chunks.where("dense is not null").select("chunk_id", F.col("dense").alias("vec"))
    rows = query_sets.reranked_each(queries, late, chunks.withColumn("score", F.lit("mine")).withColumn("q", F.lit("own")), tokens, limit=3).collect()
    assert rows and all(r.chunk_rank == "p" and r.chunk_score == "mine" and r.chunk_q == "own" and isinstance(r.score, float) for r in rows)
