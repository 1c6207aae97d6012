"""A pipeline over `documents`: toxicity, near-dedup, substring dedup, benchmark decontamination, packing.

Each stage works on all that the one before kept; what it decides takes effect on the rows it returns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwood.llm import decontam, exchange, packing, similar, substring, toxicity

#: Least Jaccard similarity of near copies' sets of five-word shingles.
SIMILARITY = 0.8

ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier toxic than not go.  The model learns from the labelled documents among those given.

    Null and empty texts stay, and rows that repeat an id are judged by their own texts; no documents give none.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit(toxicity.severity_grades(docs, labels), 3))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row of the smallest doc_id stays; null texts and blank ones are a group.

    Rows are dropped, not ids: a row with a doc_id of another row, or with none, is judged by its own text.
    """
    return similar.drop_copies(docs, shingle=5, similarity=SIMILARITY)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document holds are cut, with the white space after them; all else stays as it is.

    Null texts stay null or become empty, no row goes; rows of one id are one another's own copies and not earlier.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = substring.cut_repeats(docs, carry=F.struct(*[F.col(f"`{c}`") for c in others]) if others else None, layout=True)
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept_text")}
    if "n_chars" in others:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("kept_text")).otherwise(F.col("carried.n_chars"))
    return rows.select(*[(new[c] if c in new else F.col(f"carried.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark item, or the whole of a shorter one, go."""
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in sequences of at most 4096; a null or empty text is its end mark, no documents give no pieces."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over `documents`, each one's rows written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = exchange.staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
