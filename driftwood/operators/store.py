"""The chunk store: upserts, deletes, change detection, completeness, catalogue, keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(stored: DataFrame, new: DataFrame, key: str, version: list[str]) -> DataFrame:
    """The last version of each key; a row of `new` wins over a stored one of the same version."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(*[F.desc(v) for v in version], F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def last_versions(rows: DataFrame, key: str, version: list[str]) -> DataFrame:
    return upsert(rows.limit(0), rows, key, version)


def delete_documents(stored: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    return stored.join(gone.select(key).distinct(), key, "left_anti")


def indexed_state(chunks: DataFrame, key: str, stamp: str) -> DataFrame:
    """The latest stamp of each document; rows without either don't count."""
    return chunks.where(F.col(key).isNotNull() & F.col(stamp).isNotNull()).groupBy(key).agg(F.max(stamp).alias(stamp))


def incremental_plan(files: DataFrame, state: DataFrame, key: str, stamp: str) -> DataFrame:
    """NEW, REINDEX (newer than what is indexed) or SKIP for each file."""
    known = state.select(key, F.col(stamp).alias("_known"))
    action = F.when(F.col("_known").isNull(), "NEW").when(F.col(stamp) > F.col("_known"), "REINDEX").otherwise("SKIP")
    return files.join(known, key, "left").withColumn("action", action).drop("_known")


def catalogue(chunks: DataFrame, key: str, title: str, order: str) -> DataFrame:
    """(key, title, n_chunks) of each document, by its title's lower case; the title is that of its first chunk, `?` without one."""
    rows = chunks.groupBy(key).agg(F.coalesce(F.min_by(title, order), F.lit("?")).alias(title), F.count("*").alias("n_chunks"))
    return rows.orderBy(F.lower(title), key)


def batch_report(chunks: DataFrame, batch: str, index: str, path: str, place: str) -> DataFrame:
    """(batch, n_chunks, new_files, last_path) of each batch: chunks that are a file's first are new files; the path of the last chunk by `place`."""
    return chunks.groupBy(batch).agg(F.count("*").alias("n_chunks"), F.count_if(F.col(index) == 0).alias("new_files"), F.max_by(path, place).alias("last_path"))


def complete(chunks: DataFrame, key: str, total: str) -> DataFrame:
    """Documents that have as many chunks as they should: key and n_chunks."""
    return chunks.groupBy(key).agg(F.count("*").alias("n_chunks"), F.max(total).alias("_total")).where("_total > 0 and n_chunks >= _total").drop("_total")


def keyword_weights(terms: DataFrame, key: str, weight: str, top: int) -> DataFrame:
    """A document's terms of greatest weight, with their rank from 1; ties by term."""
    w = Window.partitionBy(key).orderBy(F.desc(weight), "term")
    return terms.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


# Words that are no keywords.
STOPWORDS = "le la les un une des et ou de du au aux à en pour par sur dans avec sans the a an and or of in on for with to at is are was were".split()


def shown_keywords(weighted: DataFrame, key: str, term: str, weight: str, top: int = 10, least: int = 3) -> DataFrame:
    """(key, rank, term): a document's best terms that are words.

    Marks of word pieces are cut off; short ones, stopwords and numbers go; of spellings that differ in case the one of
    greatest weight stays.  Ties by term.
    """
    rows = weighted.withColumn(term, F.regexp_replace(F.trim(term), "^[#▁ ]+", ""))
    low = F.lower(F.col(term))
    rows = rows.where((F.char_length(term) >= least) & ~low.isin(STOPWORDS) & ~F.col(term).rlike(r"^\d+$"))
    first = Window.partitionBy(key, low).orderBy(F.desc(weight), term)
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    order = Window.partitionBy(key).orderBy(F.desc(weight), term)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(key, "rank", term)


def decoded(weighted: DataFrame, vocabulary: DataFrame, token: str = "token") -> DataFrame:
    """The weighted tokens with their text from a vocabulary (token, text), a table like others; a token that is in none goes."""
    return weighted.join(vocabulary.select(token, "text"), token)


def sparse_vectors(keywords: DataFrame, key: str, term: str, score: str) -> DataFrame:
    """(key, idx, value): hashed keywords, those of lower score weighing more; the greatest value is 1.

    Of keywords that hash alike the one of least score stays.
    """
    from driftwood.functions.columns import sparse_index

    rows = keywords.withColumn("idx", sparse_index(F.col(term))).withColumn("_v", 1.0 / (F.col(score) + 1e-9))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key, "idx").orderBy(score, term))).where("_n = 1")
    return rows.withColumn("value", F.col("_v") / F.max("_v").over(Window.partitionBy(key))).select(key, "idx", "value")
