"""Toxicity: cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(t_k - w.x): one set of weights is shared by all ordered thresholds t_k.  Features are words
and word beginnings that tell grades apart in a bounded sample of labelled rows; a feature's value is log(1 + count).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.llm.decontam import words_of
from driftwood.llm.exchange import staged

#: Labelled rows to learn from at most, and features to keep.
SAMPLE, FEATURES = 8_192, 4_096
#: Bytes of a word's beginning that make a feature of their own.
PREFIX = 5


def features_of(text: bytes) -> Counter:
    """Words, and beginnings of longer words (marked by a space), with their counts."""
    words = Counter(words_of(text))
    out = Counter(words)
    for w, n in words.items():
        if len(w) > PREFIX:
            out[b" " + w[:PREFIX]] += n
    return out


@dataclass
class Model:
    features: dict[bytes, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, by row."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))

    def score(self, texts: list[bytes]) -> np.ndarray:
        known, w = self.features, self.weights
        heads = {f[1:] for f in known if f[:1] == b" "}
        out = np.zeros(len(texts))
        for k, t in enumerate(texts):
            words = Counter(words_of(t))
            found: Counter = Counter()
            for x in words.keys() & known.keys():
                found[x] += words[x]
            for x, n in words.items():
                if len(x) > PREFIX and x[:PREFIX] in heads:
                    found[b" " + x[:PREFIX]] += n
            out[k] = sum(w[known[x]] * np.log1p(n) for x, n in found.items())
        return out


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grade: np.ndarray, n_features: int, grades: int, l2: float = 1e-5, steps: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of a cumulative-link model by Adam; (rows, cols, values) is the sparse design.

    Thresholds are a first one plus positive steps, so they stay in order.
    """
    n = len(grade)
    share = np.clip([np.mean(grade <= k) for k in range(grades - 1)], 1e-3, 1 - 1e-3) if n else np.full(grades - 1, 0.5)
    t = np.log(share / (1 - share))
    theta = np.concatenate([np.zeros(n_features), t[:1], np.log(np.maximum(np.diff(t), 1e-2))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1 if n else 1):
        w, gaps = theta[:n_features], np.exp(theta[n_features + 1 :])
        t = theta[n_features] + np.concatenate([[0], np.cumsum(gaps)])
        s = np.bincount(rows, values * w[cols], n)
        low = np.concatenate([[-np.inf], t])[grade] - s
        high = np.concatenate([t, [np.inf]])[grade] - s
        with np.errstate(over="ignore"):
            a, b = 1 / (1 + np.exp(-low)), 1 / (1 + np.exp(-high))
        p = np.maximum(b - a, 1e-12)
        da, db = a * (1 - a) / p, b * (1 - b) / p
        g_s = (db - da) / n  # of the negative log likelihood by the row's score
        g_t = (np.bincount(grade, da, grades)[1:] - np.bincount(grade, db, grades)[:-1]) / n
        back = np.cumsum(g_t[::-1])[::-1]
        g = np.concatenate([np.bincount(cols, values * g_s[rows], n_features) + l2 * w, back[:1], back[1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:n_features], theta[n_features] + np.concatenate([[0], np.cumsum(np.exp(theta[n_features + 1 :]))])


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch: how many texts of each side have each feature."""
    for batch in batches:
        seen: dict[bytes, list[int]] = {}
        for text, grade in zip(batch["text"].cast(pa.binary()).to_pylist(), batch["grade"].to_pylist()):
            for f in features_of(text or b""):
                seen.setdefault(f, [0, 0])[grade > 0] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array([x[0] for x in seen.values()], pa.int64()), pa.array([x[1] for x in seen.values()], pa.int64())], names=["feature", "low", "high"])


def _design(features: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols, counts = [], []
            for text in batch["text"].cast(pa.binary()).to_pylist():
                found = {features[f]: n for f, n in features_of(text or b"").items() if f in features}
                cols.append(list(found))
                counts.append(list(found.values()))
            yield pa.RecordBatch.from_arrays([batch["grade"], pa.array(cols, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=["grade", "cols", "counts"])

    return run


def fit(labelled: DataFrame, grades: int, sample: int = SAMPLE, features: int = FEATURES) -> Model:
    """Learn from text and grade (0 to grades - 1) of at most `sample` rows, taken by a hash of the text.

    Features are the `features` ones whose presence differs most (chi-square) between grade 0 and above, in at least
    two rows.  The driver gets those and the sample's counts of them, both bounded.  Rows without a grade don't count;
    without rows the model gives each text the same severity.
    """
    rows = labelled.where(F.col("grade").between(0, grades - 1)).select("text", F.col("grade").cast("int").alias("grade"))
    rows = staged(rows.orderBy(F.xxhash64("text"), "text", "grade").limit(sample).repartition(8), "sample")
    side = {bool(r.up): r.n for r in rows.groupBy((F.col("grade") > 0).alias("up")).agg(F.count("*").alias("n")).collect()}
    n0, n1 = max(1, side.get(False, 0)), max(1, side.get(True, 0))
    seen = rows.mapInArrow(_presence, "feature binary, low long, high long").groupBy("feature").agg(F.sum("low").alias("low"), F.sum("high").alias("high"))
    n, a, b = float(n0 + n1), F.col("low"), F.col("high")
    # the difference beyond what one odd row would make
    chi = n * F.pow(F.greatest(F.abs(a * n1 - b * n0) - n / 2, F.lit(0.0)), 2) / ((a + b) * (n + 1 - a - b) * n0 * n1)
    top = seen.where(a + b >= 2).orderBy(chi.desc(), "feature").limit(features).collect()
    known = {bytes(r.feature): k for k, r in enumerate(top)}
    got = rows.mapInArrow(_design(known), "grade int, cols array<int>, counts array<int>").toArrow()
    cols, counts = got["cols"].combine_chunks(), got["counts"].combine_chunks()
    size = np.array([len(x) for x in cols.to_pylist()], np.int64)
    weights, thresholds = fit_ordinal(
        np.repeat(np.arange(len(size)), size), cols.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.log1p(counts.flatten().to_numpy(zero_copy_only=False)), got["grade"].to_numpy().astype(np.int64), len(known), grades
    )
    return Model(known, weights, thresholds)


def severity_grades(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text and grade of labelled documents: 0 clean, 1 toxic, 2 toxic and, by length, richer than most in what marks toxic texts.

    The labels only say toxic or not.  What marks toxic texts is learned from them (two grades); the toxic texts whose
    score per word is above the median of toxic texts get grade 2.
    """
    wanted = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("grade"))
    wanted = wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = staged(docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").select("text", (F.col("grade") > 0).cast("int").alias("grade")).where("text is not null"), "labelled")
    marks = fit(rows, 2, sample)
    held = rows.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].cast(pa.binary()).to_pylist()
            per = held.value.score(texts) / np.array([max(1, len(words_of(t))) for t in texts])
            yield pa.RecordBatch.from_arrays([batch["text"], batch["grade"], pa.array(per)], names=["text", "grade", "per_word"])

    rows = staged(rows.mapInArrow(run, "text string, grade int, per_word double"), "marked")
    middle = rows.where("grade = 1").agg(F.percentile("per_word", 0.5)).first()[0]
    return rows.select("text", F.when((F.col("grade") == 1) & (F.col("per_word") > F.lit(middle)), 2).otherwise(F.col("grade")).alias("grade"))


def grade_texts(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, severity (expected grade), p_toxic (probability of a grade above 0), grade (the likeliest) and toxic (p_toxic >= threshold).

    One row per input row; a null or blank text has no features and gets the model's base severity; other columns are
    ignored; no shuffle.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above = held.value.above(held.value.score([t or b"" for t in batch["text"].cast(pa.binary()).to_pylist()]))
            shares = -np.diff(np.column_stack([np.ones(len(above)), above, np.zeros(len(above))]), axis=1)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array(shares.argmax(axis=1).astype(np.int32))], names=["doc_id", "severity", "p_toxic", "grade"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, severity double, p_toxic double, grade int").withColumn("toxic", F.col("p_toxic") >= threshold)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose probability of a grade above 0 is under the threshold."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above = held.value.above(held.value.score([t or b"" for t in batch["text"].cast(pa.binary()).to_pylist()]))
            yield batch.filter(pa.array(above[:, 0] < threshold))

    return docs.mapInArrow(run, docs.schema)
