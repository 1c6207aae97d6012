"""The registered queries of the retrieval operators and the SQL (DuckDB) that gives the same rows.

Documents stand for chunks (their `embeddings` row of the same id is the dense vector, `source` the document they
belong to), events for versions of records, conversations for ordered chunks, labels for what is indexed already.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwood.functions import columns as C
from driftwood.functions import display
from driftwood.operators import ann, buckets, chunking, encoding, indexing, keyphrases as phrases, late, postings, query_sets, retrieval, staging, store
from driftwood.operators.scans import Scan
from driftwood.streaming import indexing as stream
from driftwood.streaming import liveness

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

WORDS = ["the", "tion", "heit"]


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- text ---------------------------------------------------------------------------------------------------------

_SQUEEZED = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@_query(rf"SELECT doc_id, CAST(p // 1300 AS INTEGER) AS chunk_index, substr(t, p + 1, 1500) AS content FROM (SELECT doc_id, t, unnest(range(0, length(t), 1300)) AS p FROM (SELECT doc_id, {_SQUEEZED} AS t FROM documents))")
def chunk_fixed_window(spark, sf):
    return chunking.fixed_windows(_read(spark, sf, "documents"))


_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda s: trim(regexp_replace(s, '^\s+|\s+$', '', 'g'))), lambda s: s <> '')"


@_query(rf"SELECT doc_id, CAST(i - 1 AS INTEGER) AS position, ss[i] AS sentence FROM (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM (SELECT doc_id, {_SENTENCES} AS ss FROM documents))")
def sentence_split(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", F.posexplode(C.sentences(F.col("text"))).alias("position", "sentence"))


@_query()
def chunk_hybrid(spark, sf):
    return chunking.hybrid(_read(spark, sf, "documents"))


@_query()
def chunk_paragraph_tokens(spark, sf):
    lines = C.nonblank(F.split("text", "\n"))
    return chunking.by_paragraphs(_read(spark, sf, "documents"), lines)


@_query(rf"SELECT doc_id, CAST(CASE WHEN {_SQUEEZED} = '' THEN 0 ELSE len(string_split({_SQUEEZED}, ' ')) END AS INTEGER) AS n_words FROM documents")
def word_token_count(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", C.word_count(F.col("text")).alias("n_words"))


@_query(r"SELECT doc_id, regexp_matches(l, '^#{1,6}\s+\S') OR regexp_matches(l, '^\d+\.\s+\S') OR regexp_matches(regexp_replace(l, '\P{L}', '', 'g'), '^\p{Lu}{3,}$') AS heading FROM (SELECT doc_id, string_split(trim(text), chr(10))[1] AS l FROM documents)")
def heading_flag(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", C.is_heading(F.col("text")).alias("heading"))


_EXCERPTS = rf"""WITH s AS (SELECT doc_id, i, ss[i] AS s, len(list_filter(['the', 'tion', 'heit'], lambda k: contains(lower(ss[i]), k))) AS h FROM (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM (SELECT doc_id, {_SENTENCES} AS ss FROM documents))),
c AS (SELECT *, row_number() OVER w AS n, sum(length(s) + 1) OVER w - 1 AS size FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY h DESC, i ROWS UNBOUNDED PRECEDING)),
e AS (SELECT doc_id, string_agg(s, ' ' ORDER BY n) FILTER (size <= 300 AND size - length(s) - 1 < 150) AS best, arg_min(s, i) AS first FROM c GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN e.doc_id IS NULL THEN trim(left(text, 300)) WHEN best IS NOT NULL THEN best WHEN length(first) > 300 THEN rtrim(left(first, 300)) || '…' ELSE first END AS excerpt FROM documents d LEFT JOIN e ON d.doc_id = e.doc_id"""


@_query(_EXCERPTS)
def best_excerpt(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", C.excerpt(F.col("text"), WORDS).alias("excerpt"))


@_query(f"SELECT doc_id, array_to_string(CASE WHEN len(f) = 0 THEN ['the', 'tion', 'heit'] ELSE f END, ',') AS keywords FROM (SELECT doc_id, list_filter(['the', 'tion', 'heit'], lambda k: contains(lower(text), k)) AS f FROM documents)")
def display_keywords(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", F.array_join(C.shown_keywords(WORDS, F.col("text")), ",").alias("keywords"))


@_query("SELECT doc_id, source FROM documents WHERE contains(lower(concat_ws(' ', source, lang)), 'src1')")
def title_filter(spark, sf):
    return _read(spark, sf, "documents").where(F.contains(F.lower(F.concat_ws(" ", "source", "lang")), F.lit("src1"))).select("doc_id", "source")


@_query("SELECT doc_id, CAST(('0x' || right(md5(lower(source)), 5)) AS INTEGER) AS sparse_index, sha1(source || '/' || doc_id) AS doc_key FROM documents")
def hashed_ids(spark, sf):
    docs = _read(spark, sf, "documents")
    return docs.select("doc_id", C.sparse_index(F.col("source")).alias("sparse_index"), F.sha1(F.concat_ws("/", "source", F.col("doc_id").cast("string"))).alias("doc_key"))


@_query("""WITH c AS (SELECT doc_id, sha1(CAST(doc_id AS VARCHAR)) || '_0' AS name FROM documents),
h AS (SELECT doc_id, md5(name) AS m, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(name)) AS s FROM c)
SELECT doc_id, CAST(CAST(('0x' || right(m, 16)) AS UBIGINT) & CAST(9223372036854775807 AS UBIGINT) AS BIGINT) AS point_id,
substr(s, 1, 8) || '-' || substr(s, 9, 4) || '-5' || substr(s, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(s, 17, 1)) AS INTEGER) % 4 + 1, 1) || substr(s, 18, 3) || '-' || substr(s, 21, 12) AS uuid FROM h""")
def point_ids(spark, sf):
    chunk = F.concat_ws("_", F.sha1(F.col("doc_id").cast("string")), F.lit("0"))
    return _read(spark, sf, "documents").select("doc_id", C.point_id(chunk).alias("point_id"), C.uuid5(chunk).alias("uuid"))


# --- vectors and ranking --------------------------------------------------------------------------------------------

#: Queries are the rows whose id is divisible by this, against all rows.
EACH = 50

_DENSE = f"""qs AS (SELECT vec_id AS q, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % {EACH} = 0),
ds AS (SELECT q, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), qv), 9) AS score FROM embeddings, qs)"""


def _vector_queries(vectors: DataFrame) -> DataFrame:
    return vectors.where(F.col("vec_id") % EACH == 0).select(F.col("vec_id").alias("q"), F.col("embedding").alias("q_vec"))


@_query(f"WITH {_DENSE} SELECT q, vec_id, round(score, 6) AS score FROM ds QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) <= 50")
def dense_topk(spark, sf):
    vectors = _read(spark, sf, "embeddings")
    return query_sets.dense_each(_vector_queries(vectors), vectors, 50, "vec_id", "embedding").select("q", "vec_id", F.round("score", 6).alias("score"))


def _indexed(spark, sf) -> tuple[DataFrame, ann.Index]:
    vectors = _read(spark, sf, "embeddings")
    folder = staging.shared_folder(spark)
    ann.build(vectors, folder, "vec_id", "embedding")
    return _vector_queries(vectors), ann.Index(spark, folder)


@_query()
def ann_topk(spark, sf):
    """An index of all vectors is written, and searched in the lists nearest to each query."""
    queries, index = _indexed(spark, sf)
    return index.search(queries, 50, key="vec_id").select("q", "vec_id", F.round("score", 6).alias("score"))


@_query(ORACLE["dense_topk"])
def ann_all_lists(spark, sf):
    """With all lists probed and all their rows scored an index gives what the exact search does."""
    queries, index = _indexed(spark, sf)
    return index.search(queries, 50, probes=len(index.model.lists), rerank=0, key="vec_id").select("q", "vec_id", F.round("score", 6).alias("score"))


_POSTINGS = f"""tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS term FROM documents) WHERE term <> '' GROUP BY ALL),
w AS (SELECT term, df, most, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT term, count(*) AS df, max(tf) AS most FROM tf GROUP BY term), (SELECT count(*) AS n FROM documents))"""


_ASKED = f"qt AS (SELECT doc_id AS q, term FROM tf WHERE doc_id % {EACH} = 0 AND length(term) >= 3 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term) <= 3)"


def _sparse(k: int) -> str:
    return f"""WITH {_POSTINGS}, {_ASKED}, s AS (SELECT q, doc_id, round(sum(tf * idf), 9) AS score FROM tf JOIN w USING (term) JOIN qt USING (term) GROUP BY ALL)
SELECT q, doc_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) <= {k}"""


def _word_queries(docs: DataFrame) -> DataFrame:
    """q and words of the documents that are queries: their three most frequent words."""
    return query_sets.top_words(docs.where(F.col("doc_id") % EACH == 0), "doc_id", "text").withColumnRenamed("doc_id", "q")


@_query(_sparse(50))
def sparse_idf_score(spark, sf):
    docs = _read(spark, sf, "documents")
    return query_sets.sparse_each(_word_queries(docs), docs, 50, "doc_id").select("q", "doc_id", F.round("score", 6).alias("score"))


def _posted(spark, sf) -> tuple[DataFrame, postings.Index]:
    docs = _read(spark, sf, "documents")
    folder = staging.shared_folder(spark)
    postings.write(docs, folder, "doc_id")
    return _word_queries(docs), postings.Index(spark, folder)


@_query(_sparse(150))
def postings_topk(spark, sf):
    """Posting lists of all documents are written; each query is three words, searched in the blocks that can hold its hits."""
    queries, index = _posted(spark, sf)
    return index.search(queries, 150, "doc_id").select("q", "doc_id", F.round("score", 6).alias("score"))


@_query(f"WITH {_POSTINGS} SELECT term, df, CAST(most AS INTEGER) AS most_in_a_document, round(idf, 6) AS idf FROM w")
def postings_terms(spark, sf):
    """What the stored lists say of each term: frequency in the term table, length and greatest count in the lists."""
    _, index = _posted(spark, sf)
    lists = index.postings.groupBy("term").agg(F.sum(F.size("keys")).alias("df"), F.max("most").alias("most_in_a_document"))
    told = lists.join(index.terms.select("term", F.col("df").alias("told")), "term", "full_outer").where("df <=> told")
    return told.select("term", "df", "most_in_a_document", F.round(retrieval.idf(F.col("df"), F.lit(index.n)), 6).alias("idf"))


def _fused(channel: int) -> str:
    return f"""WITH c AS (SELECT doc_id, source, lang, text, CAST(embedding AS DOUBLE[]) AS v FROM documents JOIN embeddings ON doc_id = vec_id),
qs AS (SELECT doc_id AS q, v AS qv FROM c WHERE doc_id % {EACH} = 0),
d AS (SELECT q, doc_id AS id, row_number() OVER (PARTITION BY q ORDER BY round(list_cosine_similarity(v, qv), 9) DESC, doc_id) - 1 AS dense_rank FROM c, qs QUALIFY dense_rank < {channel}),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS term FROM c) WHERE term <> '' GROUP BY ALL),
qt AS (SELECT doc_id AS q, term, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term) AS n FROM tf WHERE doc_id % {EACH} = 0 AND length(term) >= 3 QUALIFY n <= 3),
w AS (SELECT term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), (SELECT count(*) AS n FROM c)),
sc AS (SELECT q, doc_id AS id, round(sum(tf * idf), 9) AS score FROM tf JOIN w USING (term) JOIN qt USING (term) GROUP BY ALL),
s AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) - 1 AS sparse_rank FROM sc QUALIFY sparse_rank < {channel}),
f AS (SELECT q, id, dense_rank, sparse_rank, round(coalesce(1.0 / (61 + dense_rank), 0) + coalesce(1.0 / (61 + sparse_rank), 0), 12) AS rrf FROM d FULL JOIN s USING (q, id))"""


def _chunks(spark, sf) -> DataFrame:
    docs, vectors = _read(spark, sf, "documents"), _read(spark, sf, "embeddings")
    return docs.join(vectors, docs.doc_id == vectors.vec_id).select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc"), "text", F.col("embedding").alias("dense"), "lang")


def _text_queries(chunks: DataFrame) -> DataFrame:
    """q, q_vec and words of the chunks that are queries: a chunk's vector and its three most frequent words."""
    asked = chunks.where(F.col("chunk_id") % EACH == 0)
    words = query_sets.top_words(asked, "chunk_id", "text")
    return asked.join(words, "chunk_id", "left").select(F.col("chunk_id").alias("q"), F.col("dense").alias("q_vec"), "words")


@_query(_fused(150) + " SELECT q, id AS chunk_id, coalesce(dense_rank, -1) AS dense_rank, coalesce(sparse_rank, -1) AS sparse_rank, round(rrf, 9) AS rrf FROM f")
def rrf_fusion(spark, sf):
    chunks = _chunks(spark, sf)
    out = query_sets.fused_each(_text_queries(chunks), chunks)
    return out.select("q", "chunk_id", *[F.coalesce(F.col(c).cast("long"), F.lit(-1)).alias(c) for c in ("dense_rank", "sparse_rank")], F.round("rrf", 9).alias("rrf"))


_ORDER = "ORDER BY rrf DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST"
_HYBRID = _fused(150) + f""",
h AS (SELECT q, id, source, lang, text, rrf, dense_rank, sparse_rank FROM f JOIN c ON id = doc_id QUALIFY row_number() OVER (PARTITION BY q, source {_ORDER}) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY q {_ORDER}) - 1 AS rank FROM h QUALIFY rank < 10)"""


@_query(f"{_HYBRID} SELECT q, rank, id AS chunk_id, source AS doc, round(rrf, 9) AS rrf FROM r")
def hybrid_search(spark, sf):
    chunks = _chunks(spark, sf)
    return query_sets.hybrid_each(_text_queries(chunks), chunks).select("q", F.col("rank").cast("long").alias("rank"), "chunk_id", "doc", F.round("rrf", 9).alias("rrf"))


@_query(f"""{_HYBRID},
ws AS (SELECT q, list(term ORDER BY n) AS words FROM qt GROUP BY q),
k AS (SELECT r.*, words, list_filter(words, lambda k: contains(lower(text), k)) AS found FROM r LEFT JOIN ws USING (q)),
ss AS (SELECT q, id, i, s[i] AS s, len(list_filter(words, lambda k: contains(lower(s[i]), k))) AS h FROM (SELECT q, id, words, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT q, id, words, {_SENTENCES} AS s FROM k))),
cs AS (SELECT *, row_number() OVER w AS n, sum(length(s) + 1) OVER w - 1 AS size FROM ss WINDOW w AS (PARTITION BY q, id ORDER BY h DESC, i ROWS UNBOUNDED PRECEDING)),
e AS (SELECT q, id, string_agg(s, ' ' ORDER BY n) FILTER (size <= 300 AND size - length(s) - 1 < 150) AS best, arg_min(s, i) AS first FROM cs GROUP BY ALL)
SELECT k.q, rank, k.id AS chunk_id, source AS doc, round(rrf, 4) AS score, lang, array_to_string(CASE WHEN len(found) = 0 THEN words[1:3] ELSE found END, ',') AS keywords,
CASE WHEN e.id IS NULL THEN trim(left(text, 300)) WHEN best IS NOT NULL THEN best WHEN length(first) > 300 THEN rtrim(left(first, 300)) || '…' ELSE first END AS excerpt FROM k LEFT JOIN e ON k.q = e.q AND k.id = e.id""")
def search_results(spark, sf):
    chunks = _chunks(spark, sf)
    return query_sets.search_each(_text_queries(chunks), chunks).withColumn("keywords", F.array_join("keywords", ",")).withColumn("rank", F.col("rank").cast("long"))


@_query(_fused(50) + f""",
parts AS (SELECT vec_id, p // 16 AS part, CAST(list_slice(embedding, p + 1, p + 16) AS DOUBLE[]) AS v FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding), 16)) AS p FROM embeddings)),
m AS (SELECT f.q, f.id, a.part, max(list_dot_product(a.v, b.v)) AS s FROM f JOIN parts a ON a.vec_id = f.q JOIN parts b ON b.vec_id = f.id GROUP BY ALL),
t AS (SELECT q, id, round(sum(s), 6) AS score FROM m GROUP BY ALL)
SELECT q, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) - 1 AS rank, id AS chunk_id, source AS doc, round(score, 5) AS score FROM t JOIN c ON id = doc_id QUALIFY rank < 10""")
def search_reranked(spark, sf):
    """Parts of 16 numbers of a chunk's vector stand for the vectors of its tokens."""
    vectors, chunks = _read(spark, sf, "embeddings"), _chunks(spark, sf)
    starts = F.sequence(F.lit(1), F.size("embedding"), F.lit(16))
    tokens = vectors.select(F.col("vec_id").alias("chunk_id"), F.explode(F.transform(starts, lambda p: F.slice("embedding", p, 16))).alias("vec"))
    late = tokens.where(F.col("chunk_id") % EACH == 0).select(F.col("chunk_id").alias("q"), F.col("vec").alias("q_vec"))
    found = query_sets.reranked_each(_text_queries(chunks), late, chunks, tokens)
    return found.select("q", F.col("rank").cast("long").alias("rank"), "chunk_id", "doc", F.round("score", 5).alias("score"))


@_query(f"""WITH {_DENSE}, hits AS (SELECT * FROM ds QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) <= 150)
SELECT q, label, vec_id, round(score, 6) AS score FROM hits JOIN (SELECT vec_id, label FROM embeddings) USING (vec_id) QUALIFY row_number() OVER (PARTITION BY q, label ORDER BY score DESC, vec_id) = 1""")
def best_chunk_per_doc(spark, sf):
    """Of each query's 150 hits the best of each label."""
    vectors = _read(spark, sf, "embeddings")
    hits = query_sets.dense_each(_vector_queries(vectors), vectors, 150, "vec_id", "embedding").join(vectors.select("vec_id", "label"), "vec_id")
    best = retrieval.best_per_document(hits, ["q", "label"], [F.desc("score"), F.col("vec_id")])
    return best.select("q", "label", "vec_id", F.round("score", 6).alias("score"))


_MAXSIM = f"""WITH t AS (SELECT vec_id, vec_id // 10 AS grp, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
m AS (SELECT q.grp AS q, q.vec_id AS q_token, t.grp, max(list_dot_product(q.v, t.v)) AS s FROM t q, t WHERE q.grp % {EACH} = 0 GROUP BY ALL)
SELECT q, grp, round(sum(s), 6) AS score FROM m GROUP BY q, grp"""


def _groups(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Ten vectors in a row stand for a chunk's: those of the groups that are queries, and all."""
    tokens = _read(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 10).cast("long").alias("grp"), F.col("embedding").alias("vec"))
    return tokens.where(F.col("grp") % EACH == 0).select(F.col("grp").alias("q"), F.col("vec").alias("q_vec")), tokens


@_query(f"SELECT * FROM ({_MAXSIM}) QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, grp) <= 50")
def maxsim_scores(spark, sf):
    return query_sets.late_each(*_groups(spark, sf), 50, "grp").drop("rank")


@_query()
def maxsim_compressed(spark, sf):
    """Token vectors are kept as centroids and residuals of four bits; these choose whose true vectors are scored."""
    queries, tokens = _groups(spark, sf)
    folder = staging.shared_folder(spark)
    late.build(tokens, folder, "grp")
    return late.Index(spark, folder).search(queries, tokens, 10, "grp").drop("rank")


@_query(f"SELECT * FROM ({_MAXSIM}) QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, grp) <= 5")
def maxsim_rerank(spark, sf):
    return query_sets.late_each(*_groups(spark, sf), 5, "grp").drop("rank")


@_query("""WITH s AS (SELECT label, vec_id, round(list_cosine_similarity(CAST(lag(embedding) OVER w AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 9) AS similarity FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
c AS (SELECT label, quantile_cont(similarity, 0.25) AS cut FROM s GROUP BY label)
SELECT label, vec_id, round(similarity, 6) AS similarity, CAST(sum(CASE WHEN similarity < cut THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY vec_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM s JOIN c USING (label)""")
def semantic_boundaries(spark, sf):
    return chunking.boundaries(_read(spark, sf, "embeddings"), "label", "vec_id", "embedding").withColumn("similarity", F.round("similarity", 6))


@_query("SELECT vec_id, round(list_aggregate(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))), 'sum'), 6) AS unit_sum FROM embeddings")
def unit_vectors(spark, sf):
    return _read(spark, sf, "embeddings").select("vec_id", F.round(F.aggregate(retrieval.normalised("embedding"), F.lit(0.0), lambda s, x: s + x), 6).alias("unit_sum"))


_LETTERS = "list_transform(range(97, 123), lambda i: length(text) - length(replace(lower(text), chr(CAST(i AS INTEGER)), '')))"


@_query(f"""WITH d AS (SELECT doc_id, {_LETTERS.replace("length(text)", "length(lower(text))")} AS n FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
w AS (SELECT doc_id, n, list_sort(list_filter(list_transform(range(0, 26), lambda i: {{'w': -n[i + 1], 'i': i}}), lambda s: s.w < 0)) AS s FROM d)
SELECT doc_id, array_to_string(n, ',') AS dense, array_to_string(list_transform(s, lambda x: x.i), ',') AS sparse_idx, array_to_string(list_transform(s, lambda x: -x.w), ',') AS sparse_val FROM w""")
def encode_texts(spark, sf):
    """The encoder stage with a stand-in for a model: counts of letters."""
    rows = encoding.encode(_read(spark, sf, "documents"), encoding.letters, "doc_id")
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("long").cast("string")), ",").alias(c)
    return rows.select("doc_id", *map(joined, ("dense", "sparse_idx", "sparse_val")))


@_query()
def chunk_semantic(spark, sf):
    return chunking.semantic(_read(spark, sf, "documents"), encoding.letters)


# --- store ------------------------------------------------------------------------------------------------------------


@_query("SELECT user_id, max(CAST(floor(epoch(ts)) AS BIGINT)) AS mtime FROM events WHERE user_id IS NOT NULL GROUP BY user_id")
def indexed_state_max(spark, sf):
    return store.indexed_state(_read(spark, sf, "events").select("user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("mtime")), "user_id", "mtime")


@_query("SELECT DISTINCT conv_id FROM conversations")
def distinct_doc_ids(spark, sf):
    return _read(spark, sf, "conversations").select("conv_id").distinct()


@_query("SELECT conv_id, arg_min(role, turn) AS first_role, count(*) AS n_chunks FROM conversations GROUP BY conv_id")
def catalogue_by_doc(spark, sf):
    return _read(spark, sf, "conversations").groupBy("conv_id").agg(F.min_by("role", "turn").alias("first_role"), F.count("*").alias("n_chunks"))


@_query("SELECT lang, count(DISTINCT source) AS n_docs, count(*) AS n_chunks, CAST(round(count(*) / count(DISTINCT source)) AS BIGINT) AS per_doc FROM documents GROUP BY lang")
def catalogue_by_type(spark, sf):
    sums = _read(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n")).groupBy("lang").agg(F.count("source").alias("n_docs"), F.sum("n").alias("n_chunks"))
    return sums.withColumn("per_doc", F.round(F.col("n_chunks") / F.col("n_docs")).cast("long"))


@_query("WITH t AS (SELECT conv_id, max(turn) + 1 AS total FROM conversations GROUP BY conv_id) SELECT conv_id, count(*) AS n_chunks FROM conversations JOIN t USING (conv_id) WHERE NOT (role = 'user' AND contains(text, 'x')) GROUP BY conv_id, total HAVING total > 0 AND count(*) >= total")
def complete_docs_having(spark, sf):
    talks = _read(spark, sf, "conversations")
    totals = talks.groupBy("conv_id").agg((F.max("turn") + 1).alias("total"))
    return store.complete(talks.where(~((F.col("role") == "user") & F.contains("text", F.lit("x")))).join(totals, "conv_id"), "conv_id", "total")


@_query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'NEW' WHEN d.n_chars > l.quality * 1500 THEN 'REINDEX' ELSE 'SKIP' END AS action FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def incremental_plan(spark, sf):
    state = _read(spark, sf, "labels").select("doc_id", (F.col("quality") * 1500).alias("n_chars"))
    return store.incremental_plan(_read(spark, sf, "documents").select("doc_id", "n_chars"), state, "doc_id", "n_chars").select("doc_id", "action")


@_query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def skip_unchanged(spark, sf):
    return store.delete_documents(_read(spark, sf, "documents").select("doc_id", "n_chars"), _read(spark, sf, "labels"))


@_query("SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def force_reindex(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", "n_chars").join(_read(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")


@_query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def upsert_last_wins(spark, sf):
    return store.last_versions(_read(spark, sf, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", ["ts", "event_id"]).drop("ts")


@_query("SELECT sha1(text) AS hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_files(spark, sf):
    return _read(spark, sf, "documents").groupBy(F.sha1("text").alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@_query("""WITH tf AS (SELECT source, term, count(*) AS weight FROM (SELECT source, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS term FROM documents) WHERE length(term) >= 3 GROUP BY ALL)
SELECT source, term, weight, CAST(row_number() OVER (PARTITION BY source ORDER BY weight DESC, term) AS INTEGER) AS rank FROM tf QUALIFY rank <= 15""")
def doc_keywords_weighted(spark, sf):
    return store.keyword_weights(retrieval.terms(_read(spark, sf, "documents"), key="source").withColumnRenamed("tf", "weight"), "source", "weight", 15)


@_query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def ndjson_parse(spark, sf):
    return _read(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@_query("""SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS began, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM
(SELECT user_id, event_id, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 3600 THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def heartbeat_sessions(spark, sf):
    beats = _read(spark, sf, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    alive = stream.alive(beats, "user_id", "ts", 3600, ["event_id"])
    return alive.select("user_id", F.unix_timestamp("began").alias("began"), "n")


@_query("""WITH s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM
(SELECT user_id, event_id, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 3600 THEN 0 ELSE 1 END AS new FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)),
g AS (SELECT user_id, min(ts) AS b, max(ts) AS e, count(*) AS n FROM s GROUP BY user_id, s)
SELECT user_id, CAST(floor(epoch(b)) AS BIGINT) AS began, n FROM g WHERE epoch(e) + 3600 < (SELECT max(epoch(ts)) FROM events) - 10 - 0.002""")
def heartbeat_stream(spark, sf):
    """The events as a stream with state and timers: stretches that have ended by the last event's time."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", liveness.PROVIDER)
    events = _read(spark, sf, "events").select("user_id", "ts")
    # a pattern may be a file or a folder, a plain path must be a folder
    beats = spark.readStream.schema(events.schema).parquet(f"{sf}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = staging.shared_folder(spark)
    ended = liveness.stretches(beats, "user_id", "ts", 3600, "10 seconds")
    ended.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(ended.schema).parquet(f"{folder}/out").select("user_id", F.unix_timestamp("began").alias("began"), "n")


@_query("SELECT user_id, event_id, count_if(event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS done FROM events")
def running_progress(spark, sf):
    events = _read(spark, sf, "events").select("user_id", "event_id", "ts", "event_type")
    scan = Scan(events, ["user_id"], ["ts", "event_id"]).running(done=("sum", (F.col("event_type") == "purchase").cast("long")))
    return scan.result().select("user_id", "event_id", "done")


@_query(f"""WITH tf AS (SELECT source, term, count(*) AS weight FROM (SELECT source, unnest(regexp_split_to_array(text, '[^A-Za-z0-9]+')) AS term FROM documents) GROUP BY ALL),
w AS (SELECT * FROM tf WHERE length(term) >= 3 AND NOT regexp_matches(term, '^[0-9]+$') AND lower(term) NOT IN ({", ".join(f"'{w}'" for w in store.STOPWORDS)}) QUALIFY row_number() OVER (PARTITION BY source, lower(term) ORDER BY weight DESC, term) = 1)
SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY weight DESC, term) AS INTEGER) AS rank, term FROM w QUALIFY rank <= 10""")
def shown_keywords(spark, sf):
    # short words are no keywords whatever their count
    long = F.filter(F.split("text", "[^A-Za-z0-9]+"), lambda w: F.char_length(w) >= 3)
    words = _read(spark, sf, "documents").select("source", F.explode(long).alias("term"))
    return store.shown_keywords(words.groupBy("source", "term").agg(F.count("*").alias("weight")), "source", "term", "weight")


@_query("""WITH tf AS (SELECT source, term, count(*) AS weight FROM (SELECT source, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS term FROM documents) WHERE length(term) >= 3 GROUP BY ALL),
k AS (SELECT source, term, row_number() OVER (PARTITION BY source ORDER BY weight DESC, term) AS rank FROM tf QUALIFY rank <= 15),
i AS (SELECT source, CAST(('0x' || right(md5(term), 5)) AS INTEGER) AS idx, 1.0::DOUBLE / (rank + 1e-9::DOUBLE) AS v FROM k QUALIFY row_number() OVER (PARTITION BY source, idx ORDER BY rank, term) = 1)
SELECT source, idx, round(v / max(v) OVER (PARTITION BY source), 6) AS value FROM i""")
def sparse_vectors(spark, sf):
    return store.sparse_vectors(doc_keywords_weighted(spark, sf), "source", "term", "rank").withColumn("value", F.round("value", 6))


@_query()
def keyphrases(spark, sf):
    """Each document's twenty best phrases of up to three words."""
    return phrases.keyphrases(_read(spark, sf, "documents"))


@_query()
def keyphrase_vectors(spark, sf):
    """The keyphrases as sparse vectors."""
    # dealt by document once, for both windows
    return store.sparse_vectors(keyphrases(spark, sf).repartition("doc_id"), "doc_id", "keyphrase", "score").withColumn("value", F.round("value", 6))


@_query("SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_documents(spark, sf):
    gone = _read(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("conv_id"))
    return store.delete_documents(_read(spark, sf, "conversations").select("conv_id", "turn"), gone, "conv_id")


_LENGTHS = "SELECT vec_id // 10 AS grp, max(n_chars) AS n FROM embeddings JOIN documents ON vec_id = doc_id GROUP BY 1"


@_query(f"""WITH a AS ({_MAXSIM}), p AS (SELECT q, grp FROM a QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, grp) <= 5
UNION SELECT q, grp FROM (SELECT DISTINCT q FROM a), (SELECT grp FROM ({_LENGTHS}) ORDER BY n DESC, grp LIMIT 5))
SELECT q, grp, score FROM a JOIN p USING (q, grp) QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, grp) <= 7""")
def prefetch_union_rerank(spark, sf):
    """Two channels' best groups per query, united, ranked anew by MaxSim of these alone."""
    queries, tokens = _groups(spark, sf)
    first = query_sets.late_each(queries, tokens, 5, "grp").select("q", "grp")
    sizes = _read(spark, sf, "embeddings").join(_read(spark, sf, "documents").select("doc_id", "n_chars"), F.col("vec_id") == F.col("doc_id"))
    longest = sizes.groupBy(F.floor(F.col("vec_id") / 10).cast("long").alias("grp")).agg(F.max("n_chars").alias("n")).orderBy(F.desc("n"), "grp").limit(5)
    # five groups, given to each query
    second = queries.select("q").distinct().join(F.broadcast(longest.agg(F.collect_list("grp").alias("grps")))).select("q", F.explode("grps").alias("grp"))
    scores = query_sets.late_scores_each(first.union(second), queries, tokens, "grp")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "grp")
    return scores.withColumn("n", F.row_number().over(w)).where("n <= 7").drop("n")


@_query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM pages")
def html_escape(spark, sf):
    out = F.col("html")
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return _read(spark, sf, "pages").select("page_id", out.alias("escaped"))


@_query("SELECT doc_id, CASE WHEN n_chars > 10000 THEN 'filename_only' WHEN n_chars > 4000 THEN 'head_only' ELSE 'full' END AS mode FROM documents")
def reading_mode(spark, sf):
    from driftwood.sources.files import mode

    return _read(spark, sf, "documents").select("doc_id", mode(F.col("n_chars"), F.lit(None).cast("int"), head=4000, name=10_000).alias("mode"))


@_query("SELECT user_id, CAST(round_even(100.0 * d / n, 0) AS INTEGER) AS percent FROM (SELECT user_id, count(*) AS n, count_if(event_type = 'purchase') AS d FROM events GROUP BY user_id)")
def progress_percent(spark, sf):
    sums = _read(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("d"))
    return sums.select("user_id", display.percent_done(F.col("d"), F.col("n")).alias("percent"))


@_query("""SELECT doc_id, CASE WHEN n_chars IS NULL OR n_chars = 0 THEN '–' WHEN n_chars < 60 THEN n_chars || 's' WHEN n_chars < 3600 THEN (n_chars // 60) || 'm' || CASE WHEN n_chars % 60 > 0 THEN ' ' || (n_chars % 60) || 's' ELSE '' END
ELSE (n_chars // 3600) || 'h' || CASE WHEN n_chars // 60 % 60 > 0 THEN ' ' || (n_chars // 60 % 60) || 'm' ELSE '' END END AS eta FROM documents""")
def remaining_time(spark, sf):
    """Numbers of characters stand for seconds."""
    return _read(spark, sf, "documents").select("doc_id", display.remaining(F.col("n_chars")).alias("eta"))


@_query("""SELECT event_id, least(value, 100) AS width, CASE WHEN value >= 80 THEN 'critical' WHEN value >= 50 THEN 'warn' ELSE 'ok' END AS cpu, CASE WHEN value >= 80 THEN 'critical' WHEN value >= 55 THEN 'warn' ELSE 'ok' END AS ram FROM events""")
def load_bars(spark, sf):
    both = _read(spark, sf, "events").select("event_id", display.bar(F.col("value"), "cpu").alias("c"), display.bar(F.col("value"), "ram").alias("r"))
    return both.select("event_id", F.col("c.width").alias("width"), F.col("c.level").alias("cpu"), F.col("r.level").alias("ram"))


@_query("SELECT doc_id, array_to_string(list_slice(l, greatest(len(l) - 49, 1), len(l)), '|') AS tail FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def log_tail(spark, sf):
    """The lines of a text stand for those of a log."""
    return _read(spark, sf, "documents").select("doc_id", F.array_join(display.log_tail(F.split("text", "\n")), "|").alias("tail"))


@_query("SELECT source, lower(arg_min(lang, doc_id)) AS title, count(*) AS n_chunks, row_number() OVER (ORDER BY lower(arg_min(lang, doc_id)), source) AS place FROM documents GROUP BY source")
def catalogue_by_title(spark, sf):
    """Documents stand for chunks, their source for the document and their language for its title."""
    rows = store.catalogue(_read(spark, sf, "documents"), "source", "lang", "doc_id")
    # one row a source
    return rows.select("source", F.lower("lang").alias("title"), "n_chunks", F.row_number().over(Window.orderBy(F.lower("lang"), "source")).cast("long").alias("place"))


@_query("SELECT conv_id // 10 AS batch, count(*) AS n_chunks, count_if(turn = 0) AS new_files, arg_max(conv_id || '/' || turn, conv_id * 1000000 + turn) AS last_path FROM conversations GROUP BY 1")
def batch_reports(spark, sf):
    """Ten conversations are a batch, their turns chunks."""
    path = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    rows = _read(spark, sf, "conversations").select(F.floor(F.col("conv_id") / 10).cast("long").alias("batch"), "turn", path.alias("path"), F.struct("conv_id", "turn").alias("place"))
    return store.batch_report(rows, "batch", "turn", "path", "place")


@_query("SELECT doc_id, md5(source) AS path_id, url_encode(source || ' é/&') AS encoded, upper(lang) || ',score ' || format('{:.4f}', n_chars / 8) AS labels FROM documents")
def path_ids_and_badges(spark, sf):
    labels = F.array_join(display.badges(F.col("lang"), F.col("n_chars") / 8, F.array().cast("array<string>")), ",")
    return _read(spark, sf, "documents").select("doc_id", C.path_id(F.col("source")).alias("path_id"), C.percent_encoded(F.concat("source", F.lit(" é/&"))).alias("encoded"), labels.alias("labels"))


# --- indexing -----------------------------------------------------------------------------------------------------


@_query("SELECT d.doc_id, sha1(d.text) AS file_hash FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE d.text IS NULL OR l.doc_id IS NULL OR l.toxic = 1 OR l.quality <= 0.5")
def changed_files(spark, sf):
    """Labelled documents are the store: of toxic ones the digest is empty, of poor ones another."""
    files = _read(spark, sf, "documents").select("doc_id", F.sha1("text").alias("file_hash"))
    labels = _read(spark, sf, "labels").select("doc_id", "toxic", "quality")
    digest = F.when(F.col("toxic") == 1, "").when(F.col("quality") <= 0.5, F.sha1("file_hash")).otherwise(F.col("file_hash"))
    return indexing.changed(files, files.join(labels, "doc_id").select("doc_id", digest.alias("file_hash")), "doc_id", "file_hash").select("doc_id", "file_hash")


@_query(rf"""WITH n AS (SELECT conv_id AS doc_id, turn AS p, text AS content FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
UNION ALL SELECT doc_id, p, substr(t, p + 1, 1500) FROM (SELECT doc_id, t, unnest(range(0, length(t), 1300)) AS p FROM (SELECT doc_id, {_SQUEEZED} AS t FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)))),
c AS (SELECT doc_id, content, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS INTEGER) AS chunk_idx, count(*) OVER (PARTITION BY doc_id) AS chunk_total FROM n),
h AS (SELECT *, doc_id || '_' || chunk_idx AS chunk_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(doc_id || '_' || chunk_idx)) AS s FROM c)
SELECT chunk_id, doc_id, chunk_idx, chunk_total, content, substr(s, 1, 8) || '-' || substr(s, 9, 4) || '-5' || substr(s, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(s, 17, 1)) AS INTEGER) % 4 + 1, 1) || substr(s, 18, 3) || '-' || substr(s, 21, 12) AS uuid FROM h""")
def replace_documents(spark, sf):
    """Conversations are the store, their turns its chunks; those whose id a toxic label has become windows of that document."""
    touched = _read(spark, sf, "labels").where("toxic = 1").select("doc_id")
    stored = indexing.numbered(_read(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.col("text").alias("content")), "doc_id", "turn").drop("turn")
    docs = _read(spark, sf, "documents").select("doc_id", "text").join(touched.distinct(), "doc_id", "left_semi")
    new = indexing.numbered(chunking.fixed_windows(docs), "doc_id", "chunk_index").drop("chunk_index")
    return indexing.replace_documents(stored, new, touched).select("chunk_id", "doc_id", "chunk_idx", "chunk_total", "content", "uuid")


@_query(ORACLE["replace_documents"])
def bucketed_store(spark, sf):
    """As replace_documents, with the store in buckets of which only those of touched documents are written again."""
    touched = _read(spark, sf, "labels").where("toxic = 1").select("doc_id")
    stored = indexing.numbered(_read(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.col("text").alias("content")), "doc_id", "turn").drop("turn")
    docs = _read(spark, sf, "documents").select("doc_id", "text").join(touched.distinct(), "doc_id", "left_semi")
    new = indexing.numbered(chunking.fixed_windows(docs), "doc_id", "chunk_index").drop("chunk_index")
    columns = ["chunk_id", "doc_id", "chunk_idx", "chunk_total", "content", "uuid"]
    kept = buckets.BucketStore(spark, staging.shared_folder(spark)).create(stored.select(*columns))
    kept.replace(new.select(*columns), touched)
    return kept.read()


@_query(f"""WITH t AS (SELECT conv_id, turn, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS term FROM conversations),
tf AS (SELECT conv_id, turn, term, count(*) AS tf FROM t WHERE length(term) >= 3 GROUP BY ALL),
w AS (SELECT conv_id, term, sum(tf * n) AS weight FROM tf JOIN (SELECT conv_id, turn, sum(tf) AS n FROM tf GROUP BY ALL) USING (conv_id, turn) WHERE term NOT IN ({", ".join(f"'{w}'" for w in store.STOPWORDS)}) GROUP BY ALL)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY weight DESC, term) AS INTEGER) AS rank, term FROM w QUALIFY rank <= 15""")
def document_keywords(spark, sf):
    """Turns are chunks; a term's weight is its count there, a turn's length that of its terms."""
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.char_length(w) >= 3)
    turns = _read(spark, sf, "conversations").select("conv_id", words.alias("words")).select("conv_id", F.size("words").alias("n"), F.explode("words").alias("term"))
    return indexing.document_keywords(turns.withColumn("w", F.lit(1)), "conv_id", "term", "w", "n")
