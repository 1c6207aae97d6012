"""The sparse search of many queries shuffles counts of asked words, once for many queries."""

import math
import random

import pytest

from driftwood.operators import query_sets


@pytest.mark.parametrize("small", [query_sets.SMALL, 3])
def test_counts_of_asked_words(spark, monkeypatch, small):
    monkeypatch.setattr(query_sets, "SMALL", small)
    kept, staged = [], query_sets.staged
    monkeypatch.setattr(query_sets, "staged", lambda df, name: kept.append(staged(df, name)) or kept[-1])
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choices(["silt", "Delta", "mud", "clay", "rest9of"], [9, 5, 2, 1, 9], k=rng.choice([0, 2, 30])))) for k in range(200)] + [(7, "mud mud"), (300, None)]
    queries = [(k, rng.sample(["silt", "delta", "mud", "clay", "never"], 2)) for k in range(40)] + [(90, [None, "mud"]), (91, None)]
    got = query_sets.sparse_each(spark.createDataFrame(queries, "q long, words array<string>"), spark.createDataFrame(rows, "chunk_id long, text string").repartition(3), 15, block=1000, slice_=60).collect()
    words = [(k, (t or "").lower().replace("9", " ").split()) for k, t in rows]
    idf = {w: math.log(1 + (len(rows) - n + 0.5) / (n + 0.5)) for w in ("silt", "delta", "mud", "clay") for n in [sum(w in x for _, x in words)]}
    for q, asked in queries:
        asked = sorted({w for w in asked or [] if w in idf})
        want = sorted((-round(sum(x.count(w) * idf[w] for w in asked), 9), k) for k, x in words if any(w in x for w in asked))[:15]
        assert [(r.chunk_id, round(r.score, 8)) for r in sorted(got, key=lambda r: r["rank"]) if r.q == q] == [(k, round(-s, 8)) for s, k in want]
    if small > 3:
        assert {t for r in kept[0].collect() for t in r.terms} == {0, 1, 2, 4}


def test_words_do_not_go_out_for_each_block(spark):
    queries = spark.createDataFrame([(k, ["silt"]) for k in range(3)], "q long, words array<string>")
    chunks = spark.createDataFrame([(k, "silt and mud") for k in range(5)], "chunk_id long, text string")
    plan = query_sets.sparse_each(queries, chunks, 2)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "CoGroupsInPandas" not in plan and "regexp" not in plan and "lower" not in plan
