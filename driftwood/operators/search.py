"""Searches that return results: hybrid search with excerpts, and late interaction over what two channels prefetch.

Ranking sees ids, scores and one column a channel; whatever a result shows is joined to the few hits at the end.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwood.functions.columns import LIMITS, dot, excerpt, shown_keywords
from driftwood.operators import retrieval


def clamp(limit: int) -> int:
    """A number of hits between the least and the most that a search returns."""
    return max(LIMITS[0], min(LIMITS[1], limit))


def search(chunks: DataFrame, query: Column, words: list[str], limit: int = 10, channel: int = 150) -> DataFrame:
    """chunk_id, doc, score, excerpt, keywords and the payload of the best chunks, one per document, best first.

    `chunks` has chunk_id, doc, text, dense and the payload.  A score has four digits; the excerpt holds the sentences
    with the most of the query's words, keywords those of them that the text holds, or the first three.
    """
    hits = retrieval.hybrid_search(chunks, query, words, clamp(limit), channel)
    # at most LIMITS[1] rows
    hits = F.broadcast(hits.select("chunk_id", F.struct("rrf", "dense_rank", "sparse_rank").alias("_hit")))
    order = [F.desc("_hit.rrf"), F.asc_nulls_last("_hit.dense_rank"), F.asc_nulls_last("_hit.sparse_rank")]
    text, payload = F.col("text"), [c for c in chunks.columns if c not in ("chunk_id", "doc", "text", "dense")]
    shown = [F.round("_hit.rrf", 4).alias("score"), excerpt(text, words).alias("excerpt"), shown_keywords(words, text).alias("keywords")]
    return chunks.drop("dense").join(hits, "chunk_id").orderBy(*order).select("chunk_id", "doc", *shown, *[F.col(f"`{c}`") for c in payload])


def late_scores(tokens: DataFrame, late: list[list[float]], key: str = "chunk_id") -> DataFrame:
    """(key, score): the sum over the query's vectors of the best dot product with the key's vectors; `tokens`: key, vec."""
    best = [F.max(dot(F.col("vec"), retrieval.vector(v))) for v in late]
    return tokens.groupBy(key).agg(F.round(reduce(add, best), 6).alias("score"))


def prefetched(chunks: DataFrame, query: Column, words: list[str], prefetch: int = 50) -> DataFrame:
    """chunk_id of the best of the dense and of the sparse channel, each once."""
    dense = retrieval.dense_top(chunks, query, prefetch)
    sparse = retrieval.sparse_scores(chunks, words, key="chunk_id").orderBy(F.desc("score"), "chunk_id").limit(prefetch)
    return dense.select("chunk_id").union(sparse.select("chunk_id")).distinct()


def search_reranked(chunks: DataFrame, tokens: DataFrame, query: Column, words: list[str], late: list[list[float]], limit: int = 10, prefetch: int = 50) -> DataFrame:
    """The columns of `chunks` but dense, and score, of the best by late interaction among those prefetched, best first.

    `tokens` (chunk_id, vec) is joined to at most twice `prefetch` candidates before a vector is multiplied; a candidate
    without vectors is no hit.  A column named score is returned as chunk_score.  Ties by chunk_id.
    """
    near = tokens.join(F.broadcast(prefetched(chunks, query, words, prefetch)), "chunk_id")
    # at most LIMITS[1] rows
    hits = F.broadcast(late_scores(near, late).orderBy(F.desc("score"), "chunk_id").limit(clamp(limit)))
    return chunks.drop("dense").withColumnsRenamed({"score": "chunk_score"}).join(hits, "chunk_id").orderBy(F.desc("score"), "chunk_id")
