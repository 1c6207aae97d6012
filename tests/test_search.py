from pyspark.sql import functions as F

from driftwood.operators import indexing, retrieval, search

TEXTS = {
    1: ("a", "Rivers carry silt. The delta grows."),
    2: ("a", "Nothing to see here."),
    3: ("b", "Silt settles slowly! Rivers and silt make a delta.\nOther line"),
    4: ("c", None),
    5: ("d", ""),
}


def chunks(spark):
    rows = [(k, doc, text, [1.0, k / 10], f"title {k}") for k, (doc, text) in TEXTS.items()]
    return spark.createDataFrame(rows, "chunk_id long, doc string, text string, dense array<double>, title string")


def test_a_search_shows_excerpts_words_and_payload_of_one_chunk_a_document(spark):
    got = search.search(chunks(spark), retrieval.vector([1.0, 0.0]), ["silt", "delta", "zebra", "quark"], limit=3).collect()
    assert [r.doc for r in got] == ["a", "b", "c"] and [r.chunk_id for r in got] == [1, 3, 4]
    assert got[0].excerpt == "Rivers carry silt. The delta grows." and got[0].keywords == ["silt", "delta"]
    assert got[1].excerpt.startswith("Rivers and silt make a delta.") and got[1].title == "title 3"
    # first of the dense channel and second of the sparse one, where the third chunk has silt twice
    assert got[0].score == round(1 / 61 + 1 / 62, 4)
    assert search.search(chunks(spark), retrieval.vector([1.0, 0.0]), ["silt"], limit=0).count() == 1
    assert search.search(chunks(spark).limit(0), retrieval.vector([1.0, 0.0]), ["silt"]).count() == 0


def test_a_limit_is_clamped():
    assert [search.clamp(n) for n in (-3, 0, 1, 17, 50, 51)] == [1, 1, 1, 17, 50, 50]


def test_reranking_scores_candidates_of_both_channels_alone(spark):
    tokens = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [9.0, 9.0]), (3, [0.0, 3.0]), (5, [50.0, 50.0])], "chunk_id long, vec array<double>")
    one = search.search_reranked(chunks(spark), tokens, retrieval.vector([1.0, 0.0]), ["silt", "slowly"], [[1.0, 0.0], [0.0, 1.0]], prefetch=1).collect()
    # dense gives 1, sparse 3; 2 and 5 have better vectors but are no candidates
    assert [(r.chunk_id, r.score, r.title) for r in one] == [(3, 3.0, "title 3"), (1, 2.0, "title 1")]
    all_ = search.search_reranked(chunks(spark), tokens, retrieval.vector([1.0, 0.0]), ["silt"], [[1.0, 0.0], [0.0, 1.0]], limit=2).collect()
    assert [(r.chunk_id, r.score) for r in all_] == [(5, 100.0), (2, 18.0)]


def test_files_are_read_again_unless_their_digest_is_stored(spark):
    files = spark.createDataFrame([("p", "1"), ("q", "2"), ("r", ""), ("s", None), ("t", "5")], "doc_id string, file_hash string")
    stored = spark.createDataFrame([("p", "1"), ("p", "1"), ("q", "1"), ("r", ""), ("s", None)], "doc_id string, file_hash string")
    assert sorted(r.doc_id for r in indexing.changed(files, stored, "doc_id", "file_hash").collect()) == ["q", "r", "s", "t"]


def test_chunks_are_numbered_and_replaced_by_document(spark):
    old = spark.createDataFrame([("x", 5, "a"), ("x", 9, "b"), ("x", 7, "c"), ("y", 1, "d")], "doc_id string, at int, text string")
    stored = indexing.numbered(old, "doc_id", "at")
    assert [(r.chunk_id, r.chunk_idx, r.chunk_total, r.text) for r in stored.orderBy("chunk_id").collect()] == [("x_0", 0, 3, "a"), ("x_1", 1, 3, "c"), ("x_2", 2, 3, "b"), ("y_0", 0, 1, "d")]
    new = indexing.numbered(old.limit(0).union(spark.createDataFrame([("x", 1, "new")], old.schema)), "doc_id", "at")
    after = indexing.replace_documents(stored, new, spark.createDataFrame([("x",), ("x",), ("gone",)], "doc_id string"))
    assert sorted((r.chunk_id, r.text) for r in after.collect()) == [("x_0", "new"), ("y_0", "d")]


def test_keywords_of_a_document_weigh_its_chunks_by_length(spark):
    rows = [("d", "long", 1.0, 100), ("d", "short", 30.0, 1), ("d", "zero", 2.0, 0), ("d", "null", 1.5, None), ("d", "the", 500.0, 9), ("d", "Long", 1.0, 3), ("e", "42", 1.0, 1)]
    weighted = spark.createDataFrame(rows, "doc string, term string, w double, n int")
    got = indexing.document_keywords(weighted, "doc", "term", "w", "n").orderBy("doc", "rank").collect()
    assert [(r.doc, r["rank"], r.term) for r in got] == [("d", 1, "long"), ("d", 2, "short"), ("d", 3, "zero"), ("d", 4, "null")]
    assert indexing.document_keywords(weighted.where(F.lit(False)), "doc", "term", "w", "n").count() == 0
