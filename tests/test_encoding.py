import re

import numpy as np
from driftwood.operators import chunking, encoding


def test_encoder_is_built_once_a_task_and_orders_sparse_weights(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(["banana", "", None, "Zebra zoo"] * 30)], "chunk_id long, text string").repartition(2)
    got = encoding.encode(rows, encoding.letters, prefix="b").collect()
    assert len(got) == 120
    first = next(r for r in got if r.chunk_id == 0)
    assert first.dense[:2] == [3.0, 2.0] and first.sparse_idx == [0, 1, 13] and first.sparse_val == [3.0, 2.0, 2.0] and len(first.late) == 1
    assert next(r for r in got if r.chunk_id == 2).sparse_idx == [1]
    assert encoding.encode(rows.limit(0), encoding.letters).count() == 0


def test_short_segments_join_the_next_and_long_ones_are_cut():
    assert chunking.join_segments(["aa", "bbb", "c", "dddd", "e"], least=3, most=100) == ["aa bbb", "c dddd", "e"]
    assert chunking.join_segments(["a", "b", "c"], least=3, most=100) == ["a b", "c"]
    assert chunking.join_segments(["x" * 5 + " " + "y" * 9], least=3, most=6) == ["xxxxx", "yyyyyy", "yyy"]
    assert chunking.join_segments([], 3, 6) == []


def test_semantic_chunks_end_where_sentences_differ(spark):
    a, b = "Aaaa aaaa aaaa.", "Zzzz zzzz zzzz."
    text = " ".join([a] * 4 + [b] * 4)
    docs = spark.createDataFrame([(1, text), (2, " short one. "), (3, None), (4, " \n "), (5, "q" * 130), (None, text), (1, "m " * 60 + "b. " + "n " * 60)], "doc_id long, text string")
    rows = chunking.semantic(docs, encoding.letters, least=20, most=100).orderBy("doc_id", "chunk_index").collect()
    got = sorted(((r.doc_id, r.chunk_index, r.content) for r in rows), key=repr)
    cut = [" ".join([a] * 4), " ".join([a] + [b] * 4)]
    # a text of one sentence stays whole; rows without an id, or of one id, keep apart
    want = [(1, 0, cut[0]), (1, 1, cut[1]), (None, 0, cut[0]), (None, 1, cut[1]), (2, 0, "short one."), (5, 0, "q" * 130)]
    assert [g for g in got if "m m" not in g[2] and "n n" not in g[2]] == sorted(want, key=repr)
    assert {g[0] for g in got if "m m" in g[2]} == {1}


def plain_semantic(text, least=150, most=2000, share=0.25):
    """Chunks of one text from the rules, with letter counts for vectors."""
    parts = lambda t: [s.strip() for s in re.split(r"(?<=[.!?])\s+|\n{2,}", t) if s.strip()]
    if not text or not text.strip():
        return []
    said = parts(text)
    if len(text) <= most or len(said) < 2:
        return [text.strip()]
    vecs = [np.array([s.lower().count(c) for c in "abcdefghijklmnopqrstuvwxyz"], float) for s in said]
    unit = [v / np.linalg.norm(v) if v.any() else v for v in vecs]
    sims = [round(float(x @ y), 9) for x, y in zip(unit, unit[1:])]
    cut = np.percentile(sims, 100 * share)
    groups = [[said[0]]]
    for s, sim in zip(said[1:], sims):
        groups.append([s]) if sim < cut else groups[-1].append(s)
    chunks = chunking.join_segments([" ".join(g) for g in groups], least, most)
    return [chunks[0], *(f"{parts(x)[-1]} {y}".strip() for x, y in zip(chunks, chunks[1:]))]


def test_semantic_chunks_of_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted((r.doc_id, k, c) for r in docs.collect() for k, c in enumerate(plain_semantic(r.text)))
    got = chunking.semantic(docs, encoding.letters)
    assert sorted(map(tuple, got.collect())) == want
    assert "Exchange" not in got._jdf.queryExecution().toString()
