import random

import pytest

from driftwood.llm import similar

pipeline = pytest.importorskip("corpus_pipeline")


def shingles(t):
    w = t.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def pair(name, both, own):
    """Two texts with `both` shingles in common and `own` of each alone."""
    return [" ".join([f"{name}c{k}" for k in range(both + 4)] + [f"{name}{side}{k}" for k in range(own)]) for side in "xy"]


def components_of(docs, recall):
    return {r.doc_id: r.component_id for r in similar.similar_copies(docs, recall=recall).collect()}


def test_the_stage_keeps_one_of_each_pair_at_a_similarity(spark):
    made = [(f"p{k}s{n}", *case) for n, case in enumerate([(200, 25, 0.8), (340, 30, 0.85), (180, 10, 0.9), (158, 21, 0.79)]) for k in range(60)]
    texts = [t for name, both, own, _ in made for t in pair(name, both, own)]
    sets = [shingles(t) for t in texts]
    assert all(alike(sets[2 * k], sets[2 * k + 1]) == m[3] for k, m in enumerate(made))
    kept = pipeline.keep_one_of_near_copies(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "")
    kept = {r.doc_id for r in kept.collect()}
    missed = [m[3] for k, m in enumerate(made) if m[3] >= 0.8 and 2 * k + 1 in kept]
    # pairs of just 0.8 are found with a chance of 0.98
    assert kept >= {2 * k for k in range(len(made))} and set(missed) <= {0.8} and len(missed) <= 4
    assert all(2 * k + 1 in kept for k, m in enumerate(made) if m[3] < 0.8)


@pytest.mark.parametrize(("small", "tile", "pairs", "recall"), [(3, 2_000, 500, 0.999), (1, 2_000, 3, 0.999), (1, 7, 1, 0.999), (3, 2_000, 500, 1)])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, small, tile, pairs, recall):
    for name, value in (("SMALL", small), ("TILE", tile), ("PAIRS", pairs)):
        monkeypatch.setattr(similar, name, value)
    rng = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    texts = [None, "", " \n", "a", "A", "a b c d", "a b c d e", *[" ".join(w if rng.random() > 0.012 else f"n{rng.random()}" for w in base) for _ in range(60)]]
    texts += [t for k in range(12) for t in pair(f"q{k}", 100, 5 + 2 * k)] + texts[10:13]
    sets = [shingles(t or "") for t in texts]
    low = list(range(len(texts)))
    for _ in texts:
        new = [min(low[j] for j in range(len(texts)) if alike(sets[k], sets[j]) >= 0.8) for k in range(len(texts))]
        if new == low:
            break
        low = new
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert len(set(low)) > 20 and components_of(docs, recall) == dict(enumerate(low))
    assert similar.similar_copies(docs.limit(0)).count() == 0


def test_rows_without_an_id_and_repeated_ones(spark):
    a, b = pair("z", 100, 5)
    docs = spark.createDataFrame([(None, a), (7, b), (7, b), (7, "other words here"), (None, "alone")], "doc_id long, text string")
    got = sorted(similar.similar_copies(docs).collect(), key=str)
    assert [(r.doc_id, r.component_id) for r in got] == [(7, 7), (7, 7), (7, 7), (None, 7), (None, None)]


def test_rows_are_dropped_not_ids(spark):
    a, b = pair("z", 100, 5)
    rows = [(1, a, 1), (5, b, 2), (5, "a text of its own", 3), (6, "twice the same", 4), (6, "twice the same", 4), (None, a, 5), (None, "alone", 6), (8, None, 7), (9, " ", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int").repartition(3)
    kept = similar.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[k] for k in (0, 2, 3, 6, 7)], key=str)
    assert similar.drop_copies(docs.limit(0)).collect() == []


def test_a_large_group_of_near_pairs_makes_no_row_for_each(spark, monkeypatch):
    texts = [" ".join([f"c{k}" for k in range(204)] + [f"m{n}o{k}" for k in range(28)]) for n in range(80)]
    assert alike(shingles(texts[0]), shingles(texts[1])) < 0.8
    texts += pair("z", 200, 25)
    monkeypatch.setattr(similar, "SMALL", 1)
    made, stage = [], similar.staged
    monkeypatch.setattr(similar, "staged", lambda df, name="table": [out := stage(df, name), made.append((name, out.count()))][0])
    got = components_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 0.98)
    assert got == dict(enumerate([*range(81), 80]))
    assert max(n for name, n in made if name == "pairs") <= 4 * len(texts)


def test_two_far_sets_that_share_a_key_by_chance_are_not_joined(spark):
    rows = [(1, 100, 0, 5), (2, 100, -1, 5), (3, 100, 0, 6), (4, 100, 1, 6), (5, 100, 0, 7), (6, 50, 0, 7), (7, 9, 0, 8), *[(k, 100, k, 9) for k in (8, 9, 10)]]
    kept = similar._shared_keys(spark.createDataFrame(rows, "node long, n long, lane long, key long"), similar.Fraction("0.8"))
    assert sorted(map(tuple, kept.collect())) == [(6, 2), (9, 3)]


def test_a_large_group_of_near_copies_is_not_joined_for_each_of_its_blocks(spark, monkeypatch):
    base = [f"w{k}" for k in range(300)]
    texts = [" ".join(base[:n] + [f"n{n}"] + base[n + 1 :]) for n in range(120)]
    made, stage = [], similar.staged
    monkeypatch.setattr(similar, "staged", lambda df, name="table": [out := stage(df, name), made.append((name, out.count()))][0])
    assert set(components_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 0.98).values()) == {0}
    blocks = similar.plan(len(texts), 0.8, 0.98)[1]
    assert sum(n for name, n in made if name == "shared") <= len(texts) * blocks / 5
