"""Keyphrases shuffle texts once and nothing else; documents that batches cut, and texts whose best phrases all read alike."""

import random

from pyspark.sql import functions as F

from driftwood.operators import keyphrases


def test_one_shuffle_and_no_join(spark):
    df = spark.createDataFrame([(1, "Solar panels power homes.")], "doc_id long, text string")
    plan = keyphrases.keyphrases(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Aggregate" not in plan


def test_documents_cut_by_batches(spark, monkeypatch):
    rng = random.Random(5)
    words = [a + b for a in ("sol", "win", "Tur", "pan", "of") for b in ("ar", "d", "bine", "")]
    rows = [(k % 7, " ".join(rng.choices(words, k=40)) + rng.choice([".", "!", " –"])) for k in range(60)] + [(9, None), (None, "gone")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    got = []
    for batch, at_once, pairs in ((10_000, 1 << 19, 1 << 18), (2, 50, 1)):
        monkeypatch.setattr(keyphrases, "AT_ONCE", at_once)
        monkeypatch.setattr(keyphrases, "PAIRS", pairs)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            got.append((sorted(map(tuple, keyphrases.keyphrases(df).collect())), sorted(map(tuple, keyphrases.term_table(df).collect()))))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[0] == got[1] and {r[0] for r in got[0][0]} == set(range(7))
    counts = df.where("doc_id = 3").select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("term")).where("term <> ''").groupBy("term").count().collect()
    assert {r[1]: r[2] for r in got[0][1] if r[0] == 3} == {r.term: r["count"] for r in counts}


def test_phrases_that_read_alike_are_searched_to_the_end(spark):
    # thousands of names that differ by one letter in ten, and one that reads otherwise, last
    rng = random.Random(6)
    alike = sorted({"abcdefghi"[:k] + c + "abcdefghi"[k + 1 :] for k in range(9) for c in "klmnopqrstuvwxyz"})
    rng.shuffle(alike)
    text = ". ".join(["Abcdefghi"] * 30 + [w.capitalize() for w in alike] + ["Zzzzz"]) + "."
    got = [r.keyphrase for r in keyphrases.keyphrases(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()]
    assert "zzzzz" in got and len(got) < 20


def test_edits():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(7)
    a, b = (["".join(rng.choices("abé \U0001f600", k=rng.choice([0, 1, 5, 9, 30, 70]))) for _ in range(300)] for _ in range(2))
    assert keyphrases.edits(a, b).tolist() == [plain(x, y) for x, y in zip(a, b)]


def test_vectors_are_dealt_once_more(spark):
    from driftwood.jobs import registry

    plan = registry.QUERIES["keyphrase_vectors"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "Join" not in plan
