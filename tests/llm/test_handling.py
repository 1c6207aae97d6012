"""Repeated rows, rows without an id, very long texts; the ordinal model against its definition."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwood.llm import binary_ids, decontam, exchange, license_scan, lm, packing, quality, simhash, substring, token_counts, toxicity

SF = "/root/testdata/sf0.001"

PASSAGE = " ".join(f"p{k}" for k in range(30))
ROWS = [
    (1, "the cat sat on the mat and the dog ate it all up again today"), (1, "the cat sat on the mat and the dog ate it all up again today"), (2, "one two three"),
    (2, "another text under the same id"), (3, PASSAGE + " tail"), (4, "head " + PASSAGE), (4, "head " + PASSAGE), (None, "nobody's text"), (None, "nobody's text"), (None, None), (5, None), (5, ""), (6, "head " + PASSAGE),
]


@pytest.fixture(scope="module")
def repeated(spark):
    return spark.createDataFrame([(k, t, "s", "en") for k, t in ROWS], "doc_id long, text string, source string, lang string").repartition(3)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([("b", " ".join(f"p{k}" for k in range(5, 20))), ("b", " ".join(f"p{k}" for k in range(5, 20))), (None, "one two three"), ("n", None)], "item_id string, text string")


@pytest.fixture(scope="module")
def graded(spark):
    return toxicity.Model({b"cat": 0}, np.array([2.0]), np.array([1.0, 2.0]))


def per_row(spark, items, graded):
    return {
        "licenses": license_scan.scan, "quality": quality.judge, "substring": substring.cut_repeats, "counts": token_counts.count_tokens,
        "leaks": lambda d: decontam.find_leaks(d, items), "lm": lm.score_documents, "toxicity": lambda d: toxicity.grade_texts(d, graded), "simhash": simhash.near_copies,
    }


@pytest.mark.parametrize("name", ["licenses", "quality", "substring", "counts", "leaks", "lm", "toxicity", "simhash"])
def test_each_row_has_a_row_and_repeated_rows_have_the_same(spark, repeated, items, graded, name):
    out = per_row(spark, items, graded)[name](repeated)
    got = out.select("doc_id", F.to_json(F.struct(*[c for c in out.columns if c != "doc_id"])).alias("rest")).collect()
    assert Counter(r.doc_id for r in got) == Counter(k for k, _ in ROWS)
    pairs = Counter((r.doc_id, r.rest) for r in got)
    assert sum(n for (k, _), n in pairs.items() if k == 1) == 2 and sum(k == 1 for k, _ in pairs) == 1
    assert sum(k == 4 for k, _ in pairs) == 1


def test_packing_and_id_files_hold_repeated_rows_and_rows_without_an_id(spark, repeated):
    lengths = Counter(packing.pack(repeated).groupBy("doc_id").agg(F.sum("length").alias("n")).rdd.map(lambda r: (r.doc_id, r.n)).collectAsMap())
    counted = token_counts.count_tokens(repeated).groupBy("doc_id").agg(F.sum(F.col("n_tokens") + 1).alias("n")).collect()
    assert lengths == {r.doc_id: r.n for r in counted}
    folder = exchange.shared_folder(spark)
    binary_ids.write_ids(repeated, folder)
    back = sorted(binary_ids.read_ids(spark, folder).collect(), key=lambda r: r.start)
    assert Counter(r.doc_id for r in back) == Counter(k for k, _ in ROWS)
    at = 0
    for r in back:
        assert r.start == at
        at += r.n_tokens


@pytest.mark.parametrize("name", ["licenses", "quality", "substring", "counts", "leaks", "lm", "toxicity", "simhash"])
def test_one_very_long_text(spark, items, graded, name):
    rng = random.Random(3)
    text = " ".join(f"w{rng.randrange(5000)}" for _ in range(120_000)) + "\n" + PASSAGE + " " + "z" * 60_000
    docs = spark.createDataFrame([(1, text, "s", "en"), (2, "short", "s", "en")], "doc_id long, text string, source string, lang string")
    rows = {r.doc_id: r.asDict() for r in per_row(spark, items, graded)[name](docs).collect()}
    assert set(rows) == {1, 2}
    if "n_words" in rows[1]:
        assert rows[1]["n_words"] == (120_031 if name != "leaks" else len(re.findall("[a-z0-9]+", text)))


def plain_loss(w, t, design, grade, l2):
    """Mean negative log likelihood of the grades, plus the ridge, row by row from the model's definition."""
    total = 0.0
    for x, g in zip(design, grade):
        below = lambda k: 1.0 if k == len(t) else 0.0 if k < 0 else 1 / (1 + math.exp(-(t[k] - float(x @ w))))
        total -= math.log(below(g) - below(g - 1))
    return total / len(grade) + l2 / 2 * float(w @ w)


def test_the_ordinal_fit_is_the_minimum_of_the_plain_likelihood():
    rng = np.random.default_rng(5)
    design = rng.poisson(0.7, (300, 4)).astype(float)
    latent = design @ np.array([1.5, -1.0, 0.5, 0.0]) + rng.logistic(size=300)
    grade = np.digitize(latent, [0.3, 1.5])
    rows, cols = np.nonzero(design)
    w, t = toxicity.fit_ordinal(rows, cols, design[rows, cols], grade, 4, 3, l2=1e-2, steps=4000)
    at = plain_loss(w, t, design, grade, 1e-2)
    for k in range(6):
        step = np.zeros(6)
        step[k] = 1e-4
        up, down = (plain_loss(w + s * step[:4], t + s * step[4:], design, grade, 1e-2) for s in (1, -1))
        assert abs(up - down) / 2e-4 < 1e-3 and min(up, down) > at - 1e-7


def plain_features(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = Counter(w.encode() for w in re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower))
    out = Counter(words)
    for w, n in words.items():
        if len(w) > 5:
            out[b" " + w[:5]] += n
    return out


def test_the_toxicity_query_equals_a_plain_version_on_whole_tables(spark):
    """Features by chi-square and every document's severity, from the model's weights, by loops over plain words."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    marked = toxicity.severity_grades(docs, labels)
    model = toxicity.fit(marked, 3)
    rows = [(r.text, r.grade) for r in marked.collect()]
    toxic = {r.doc_id for r in labels.where("toxic = 1").select("doc_id").collect()}
    known = {r.doc_id for r in labels.where("toxic is not null").select("doc_id").collect()}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert Counter(g > 0 for _, g in rows) == Counter(k in toxic for k in known if texts.get(k) is not None)
    seen = {}
    for text, grade in rows:
        for f in plain_features(text):
            seen.setdefault(f, [0, 0])[grade > 0] += 1
    n0, n1 = sum(g == 0 for _, g in rows), sum(g > 0 for _, g in rows)
    n = n0 + n1
    chi = {f: n * max(abs(a * n1 - b * n0) - n / 2, 0.0) ** 2 / ((a + b) * (n + 1 - a - b) * n0 * n1) for f, (a, b) in seen.items() if a + b >= 2}
    assert sorted(model.features) == sorted(sorted(chi, key=lambda f: (-chi[f], f))[: toxicity.FEATURES]) or len(chi) > toxicity.FEATURES
    got = {r.doc_id: r for r in toxicity.grade_texts(docs, model).collect()}
    assert len(got) == len(texts)
    for k, text in texts.items():
        x = sum(model.weights[model.features[f]] * math.log1p(c) for f, c in plain_features(text).items() if f in model.features)
        above = [1 / (1 + math.exp(min(60, max(-60, t - x)))) for t in model.thresholds]
        assert abs(got[k].severity - sum(above)) < 1e-9 and got[k].toxic == (above[0] >= 0.5)
