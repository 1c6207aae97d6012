"""Exact searches for many queries at once: every query against every row, block by block.

Queries are dealt into blocks and rows into slices, both of bounded size.  A task scores one block against one slice with
numpy and keeps each query's best few, so that k rows a query and slice are shuffled at the end.  What is shuffled before is
the rows once per block of queries; of texts these are the counts of the words that some query has.  Neither side passes
through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwood.functions.columns import dot, excerpt, shown_keywords
from driftwood.operators import retrieval
from driftwood.operators.staging import staged

#: Queries of a block and rows of a slice.
BLOCK, SLICE = 4_096, 65_536
#: Queries of a block where they are a few words each, and different words of all queries that are numbered on the driver.
ASKED, SMALL = 65_536, 100_000
#: Scores of a query and the rows of a slice: ids of queries, ids of rows in ascending order, and one array per query.
Scored = tuple[list, list, Iterator[np.ndarray]]


def best(queries: DataFrame, rows: DataFrame, q: str, key: str, k: int, score: Callable[[pd.DataFrame, pd.DataFrame], Scored], block: int = BLOCK, slice_: int = SLICE, counts: tuple[int, int] | None = None) -> DataFrame:
    """(q, key, score, rank): each query's k rows of greatest score, ranked from 0, ties by key; a score of -inf is no hit.

    Rows of the same key, and of the same query, are scored together.  `counts` of queries and rows, or a little more than
    these, save counting them here.
    """
    counts = counts or (queries.count(), rows.count())
    n_blocks, n_slices = (max(1, -(-n // size)) for n, size in zip(counts, (block, slice_)))

    def dealt(df: DataFrame, by: str, own: str, parts: int, other: str, others: int) -> DataFrame:
        part = F.pmod(F.xxhash64(by), F.lit(parts)).cast("int")
        return df.withColumn(own, part).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            ids, keys, scores = score(left, right)
            for i, s in zip(ids, scores):
                hits = np.flatnonzero(s > -np.inf)
                if len(hits) > k:
                    hits = hits[s[hits] >= -np.partition(-s[hits], k - 1)[k - 1]]
                hits = hits[np.lexsort((hits, -s[hits]))][:k]
                out.append(pd.DataFrame({q: [i] * len(hits), key: [keys[j] for j in hits], "score": s[hits]}))
        return pd.concat(out) if out else pd.DataFrame({q: [], key: [], "score": []})

    left = dealt(queries, q, "_block", n_blocks, "_slice", n_slices).groupBy("_block", "_slice")
    right = dealt(rows, key, "_slice", n_slices, "_block", n_blocks).groupBy("_block", "_slice")
    schema = f"`{q}` {queries.schema[q].dataType.simpleString()}, `{key}` {rows.schema[key].dataType.simpleString()}, score double"
    found = left.cogroup(right).applyInPandas(run, schema)
    order = Window.partitionBy(q).orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)


def _units(vectors: pd.Series) -> np.ndarray:
    m = np.stack([np.asarray(v, np.float64) for v in vectors])
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.full_like(m, np.nan), where=norms > 0)


def dense_each(queries: DataFrame, chunks: DataFrame, k: int, key: str = "chunk_id", vector: str = "dense", **sizes: int) -> DataFrame:
    """The k chunks of greatest cosine to each query; `queries`: q, q_vec.  Null and zero vectors hit nothing."""

    def score(left: pd.DataFrame, right: pd.DataFrame) -> Scored:
        left, right = left.sort_values("q"), right.sort_values(key)
        a, b = _units(left["q_vec"]), _units(right[vector]).T
        tiles = (np.round(a[i : i + 64] @ b, 9) for i in range(0, len(a), 64))
        return list(left["q"]), list(right[key]), (np.where(np.isnan(s), -np.inf, s) for tile in tiles for s in tile)

    return best(queries.select("q", "q_vec").dropna(), chunks.select(key, vector).dropna(), "q", key, k, score, **sizes)


def words_of(text: Column, least: int = 1) -> Column:
    """Lower-case runs of a-z of some length."""
    words = F.array_remove(F.split(F.lower(text), "[^a-z]+"), "")
    return words if least == 1 else F.filter(words, lambda w: F.char_length(w) >= least)


def top_words(docs: DataFrame, key: str, text: str, n: int = 3, least: int = 3) -> DataFrame:
    """(key, words): a document's n most frequent words, ties by word."""
    words = docs.select(key, F.explode(words_of(F.col(text), least)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    kept = words.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("tf"), "term"))).where(F.col("_n") <= n)
    return kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "term"))), lambda s: s["term"]).alias("words"))


def sparse_each(queries: DataFrame, chunks: DataFrame, k: int, key: str = "chunk_id", text: str = "text", block: int = ASKED, slice_: int = SLICE) -> DataFrame:
    """The k chunks with the greatest sum of idf x tf over each query's words; `queries`: q, words (few, of a-z)."""
    spark = chunks.sparkSession
    asked = queries.select("q", F.explode(F.array_distinct("words")).alias("word")).where("word is not null")
    few = [r.word for r in asked.select("word").distinct().limit(SMALL + 1).collect()]
    number = {w: n for n, w in enumerate(sorted(few))} if len(few) <= SMALL else None
    if number is None:
        # more words than a driver should number stay words, and all words of texts are kept
        kind, asked = "string", asked.withColumn("term", F.col("word"))
    else:
        kind, asked = "int", asked.join(F.broadcast(spark.createDataFrame([*number.items()], "word string, term int")), "word")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch["words"].flatten().dictionary_encode()
            words = coded.dictionary.to_pylist()
            own = np.array([number.get(w, -1) for w in words] if number is not None else range(len(words)), np.int64)[coded.indices.to_numpy()]
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch["words"]).to_numpy())
            both, tf = np.unique((row << 32 | own)[own >= 0], return_counts=True)
            terms = pa.array((both & 0xFFFFFFFF).astype(np.int32))
            rows, n = np.unique(both >> 32, return_counts=True)
            ends = pa.array(np.append(0, np.cumsum(n)), pa.int32())
            terms = terms if number is not None else pa.array(words, pa.string()).take(terms)
            yield pa.RecordBatch.from_arrays([batch[0].take(pa.array(rows)), pa.ListArray.from_arrays(ends, terms), pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32()))], names=[key, "terms", "tfs"])

    k_type, q_type = chunks.schema[key].dataType.simpleString(), queries.schema["q"].dataType.simpleString()
    words = chunks.where(F.col(text).isNotNull()).select(key, words_of(F.col(text)).alias("words"))
    counted = staged(words.mapInArrow(count, f"`{key}` {k_type}, terms array<{kind}>, tfs array<int>"), "counted")
    n_queries, n = queries.count(), chunks.count()
    idf = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).select("term", retrieval.idf(F.col("df"), F.lit(n)).alias("idf"))
    listed = asked.join(idf, "term").groupBy("q").agg(F.sort_array(F.collect_list(F.struct("word", "term", "idf"))).alias("w"))
    weighted = listed.select("q", F.col("w.term").alias("terms"), F.col("w.idf").alias("idfs"))
    n_blocks, n_slices = max(1, -(-n_queries // block)), max(1, -(-n // slice_))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, ats, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        # rows in the order of keys, which decide between those of one score
        keys = right[key].combine_chunks()
        order = pc.array_sort_indices(keys)
        place = np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        coded = pc.list_flatten(right["terms"]).combine_chunks().dictionary_encode()
        codes = coded.indices.to_numpy()
        by_term = np.argsort(codes, kind="stable")
        rows, tfs = np.repeat(place, pc.list_value_length(right["terms"]).to_numpy())[by_term], pc.list_flatten(right["tfs"]).to_numpy()[by_term]
        number = {t: i for i, t in enumerate(coded.dictionary.to_pylist())}
        ends = np.append(0, np.cumsum(np.bincount(codes, minlength=len(number))))
        for i, (terms, idfs) in enumerate(zip(left["terms"].to_pylist(), left["idfs"].to_pylist())):
            s = np.zeros(len(order))
            for t, w in zip(terms, idfs):
                if (at := number.get(t)) is not None:
                    part = slice(ends[at], ends[at + 1])
                    s[rows[part]] += tfs[part] * w
            hits = np.flatnonzero(s)
            s = np.round(s[hits], 9)
            if len(hits) > k:
                most = s >= -np.partition(-s, k - 1)[k - 1]
                hits, s = hits[most], s[most]
            best = np.argsort(-s, kind="stable")[:k]
            ids.append(np.full(len(best), i))
            ats.append(hits[best])
            scores.append(s[best])
        return pa.table([left["q"].take(pa.array(np.concatenate(ids))), keys.take(order.take(pa.array(np.concatenate(ats)))), pa.array(np.concatenate(scores))], names=["q", key, "score"])

    def dealt(df: DataFrame, by: str, own: str, parts: int, other: str, others: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64(by), F.lit(parts)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    left = dealt(weighted, "q", "_block", n_blocks, "_slice", n_slices).groupBy("_block", "_slice")
    right = dealt(counted, key, "_slice", n_slices, "_block", n_blocks).groupBy("_block", "_slice")
    found = left.cogroup(right).applyInArrow(score, f"q {q_type}, `{key}` {k_type}, score double")
    order = Window.partitionBy("q").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)


def late_each(queries: DataFrame, tokens: DataFrame, k: int, key: str = "chunk_id", **sizes: int) -> DataFrame:
    """The k keys of greatest MaxSim to each query; `queries` (q, q_vec) and `tokens` (key, vec) have a row per vector.

    A key's vectors are scored in one task: they are those of one text chunk.
    """

    def score(left: pd.DataFrame, right: pd.DataFrame) -> Scored:
        left, right = left.sort_values("q"), right.sort_values(key)
        a, b = (np.stack([np.asarray(v, np.float64) for v in s]) for s in (left["q_vec"], right["vec"]))
        keys, starts = np.unique(right[key].to_numpy(), return_index=True)
        ids, firsts = np.unique(left["q"].to_numpy(), return_index=True)
        sums = (np.round(np.maximum.reduceat(part @ b.T, starts, axis=1).sum(axis=0), 6) for part in np.split(a, firsts[1:]))
        return ids.tolist(), keys.tolist(), sums

    return best(queries.select("q", "q_vec").dropna(), tokens.select(key, "vec").dropna(), "q", key, k, score, **sizes)


def late_scores_each(pairs: DataFrame, queries: DataFrame, tokens: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(q, key, score): MaxSim of the given pairs of query and key alone; a pair without vectors goes."""
    asked = queries.groupBy("q").agg(F.collect_list("q_vec").alias("q_vecs"))
    met = pairs.select("q", key).distinct().join(asked, "q").join(tokens.select(key, "vec").dropna(), key)
    each = met.select("q", key, F.posexplode(F.transform("q_vecs", lambda v: dot(v, F.col("vec")))).alias("part", "s"))
    return each.groupBy("q", key, "part").agg(F.max("s").alias("s")).groupBy("q", key).agg(F.round(F.sum("s"), 6).alias("score"))


def fused_each(queries: DataFrame, chunks: DataFrame, channel: int = 150, key: str = "chunk_id") -> DataFrame:
    """(q, key, dense_rank, sparse_rank, rrf): both channels' best of each query; `queries`: q, q_vec, words."""
    dense = dense_each(queries, chunks, channel, key).select("q", key, F.col("rank").alias("dense_rank"))
    sparse = sparse_each(queries, chunks, channel, key).select("q", key, F.col("rank").alias("sparse_rank"))
    return retrieval.fuse(dense, sparse, ["q", key])


def hybrid_each(queries: DataFrame, chunks: DataFrame, limit: int = 10, channel: int = 150) -> DataFrame:
    """q, chunk_id, doc, rrf, rank: each query's best chunks by fused rank, one per document; `chunks`: chunk_id, doc, text, dense."""
    hits = fused_each(queries, chunks, channel).join(chunks.select("chunk_id", "doc"), "chunk_id")
    kept = retrieval.best_per_document(hits, ["q", "doc"], retrieval.fused_order())
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*retrieval.fused_order())) - 1)
    return ranked.where(F.col("rank") < limit).select("q", "chunk_id", "doc", "rrf", "rank")


def _payload(chunks: DataFrame, used: tuple[str, ...], taken: list[str]) -> list[Column]:
    """The columns of `chunks` but the used ones, as fields of a struct _c; one named like a column of the result is prefixed with chunk_."""
    return [F.col(f"_c.`{c}`").alias(f"chunk_{c}" if c in taken else c) for c in chunks.columns if c not in used]


def _joined(hits: DataFrame, chunks: DataFrame, without: tuple[str, ...]) -> DataFrame:
    """`hits` with their chunk's columns in a struct _c, so that no name clashes."""
    kept = [F.col(f"`{c}`") for c in chunks.columns if c not in without]
    return hits.join(chunks.select("chunk_id", F.struct(*kept).alias("_c")), "chunk_id")


def search_each(queries: DataFrame, chunks: DataFrame, limit: int = 10, channel: int = 150) -> DataFrame:
    """q, rank, chunk_id, doc, score, excerpt, keywords and payload of each query's hits; text is joined to hits alone.

    A payload column with one of these names is returned as chunk_<name>.
    """
    hits = hybrid_each(queries, chunks.select("chunk_id", "doc", "text", "dense"), limit, channel).drop("doc").join(queries.select("q", F.col("words").alias("_words")), "q")
    text = F.col("_c.text")
    shown = [F.col("_c.doc").alias("doc"), F.round("rrf", 4).alias("score"), excerpt(text, F.col("_words")).alias("excerpt"), shown_keywords(F.col("_words"), text).alias("keywords")]
    payload = _payload(chunks, ("chunk_id", "doc", "text", "dense"), ["q", "rank", "score", "excerpt", "keywords"])
    return _joined(hits, chunks, ("dense",)).select("q", "rank", "chunk_id", *shown, *payload)


def reranked_each(queries: DataFrame, late: DataFrame, chunks: DataFrame, tokens: DataFrame, limit: int = 10, prefetch: int = 50) -> DataFrame:
    """q, rank, score and the columns of `chunks` but dense: each query's best by MaxSim among what two channels prefetch.

    A column of `chunks` named q, rank or score is returned as chunk_<name>.
    `late` (q, q_vec) and `tokens` (chunk_id, vec) have the vectors of queries and chunks; only candidates' are joined.
    """
    chunks_of = chunks.select("chunk_id", "text", "dense")
    near = dense_each(queries, chunks_of, prefetch).select("q", "chunk_id").union(sparse_each(queries, chunks_of, prefetch).select("q", "chunk_id"))
    scored = late_scores_each(near, late, tokens)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "chunk_id")) - 1)
    payload = _payload(chunks, ("chunk_id", "dense"), ["q", "rank", "score"])
    return _joined(ranked.where(F.col("rank") < limit), chunks, ("dense",)).select("q", "rank", "score", "chunk_id", *payload)
