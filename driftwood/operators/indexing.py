"""Steps of an indexing job: what to read again, rows of chunks, replacing a document's chunks, its keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwood.functions.columns import strip, uuid5
from driftwood.operators.chunking import hybrid
from driftwood.operators.store import delete_documents, shown_keywords


def changed(files: DataFrame, stored: DataFrame, key: str, digest: str) -> DataFrame:
    """Files whose digest is not the one stored.  A null or empty digest matches nothing, so such files stay."""
    same = stored.where(F.col(digest) != "").select(key, digest).distinct()
    return files.join(same, [key, digest], "left_anti")


def numbered(chunks: DataFrame, key: str, order: str) -> DataFrame:
    """With chunk_idx from 0 in the order of a column, chunk_total, and the chunk's id and its version 5 UUID."""
    w = Window.partitionBy(key)
    rows = chunks.withColumn("chunk_idx", F.row_number().over(w.orderBy(order)) - 1).withColumn("chunk_total", F.count("*").over(w))
    rows = rows.withColumn("chunk_id", F.concat_ws("_", F.col(key).cast("string"), "chunk_idx"))
    return rows.withColumn("uuid", uuid5(F.col("chunk_id")))


def replace_documents(stored: DataFrame, new: DataFrame, touched: DataFrame, key: str = "doc_id") -> DataFrame:
    """The store with all chunks of the touched documents replaced by `new`: none is left over from a longer version."""
    return delete_documents(stored, touched, key).unionByName(new)


def document_keywords(weighted: DataFrame, key: str, term: str, weight: str, length: str, top: int = 15) -> DataFrame:
    """(key, rank, term): a document's best terms by the weights in its chunks, each times the chunk's length.

    A length below one, or null, counts as one.  Terms of the same chunk are added up; what is no word goes.
    """
    sums = weighted.groupBy(key, term).agg(F.sum(F.col(weight) * F.greatest(F.col(length), F.lit(1))).alias("_weight"))
    return shown_keywords(sums, key, term, "_weight", top)


def first_files(files: DataFrame, most: int | None, order: str = "path") -> DataFrame:
    """At most so many files, in order; None or a number below one leaves all."""
    return files.orderBy(order).limit(most) if most and most > 0 else files


def wanted_only(files: DataFrame, wanted: DataFrame | None, key: str = "doc_id") -> DataFrame:
    """The files asked for: all for None, none for an empty table."""
    return files if wanted is None else files.join(wanted.select(key).distinct(), key, "left_semi")


def filled(docs: DataFrame, hint: str, text: str = "text", policy: str = "hint") -> DataFrame:
    """What becomes of documents whose text is null or blank: the hint is their text, or (policy "skip") they go."""
    blank = strip(F.coalesce(F.col(text), F.lit(""))) == ""
    return docs.where(~blank) if policy == "skip" else docs.withColumn(text, F.when(blank, F.col(hint)).otherwise(F.col(text)))


def event_lines(rows: DataFrame, kind: str, columns: list[str]) -> DataFrame:
    """One line of JSON per row: its type, then the columns; a null is left out."""
    return rows.select(F.to_json(F.struct(F.lit(kind).alias("type"), *columns)).alias("value"))


def index_documents(docs: DataFrame, stored: DataFrame, known: DataFrame, wanted: DataFrame | None = None, policy: str = "hint") -> tuple[DataFrame, DataFrame]:
    """The chunk store after a run, and the chunks that the run made.

    `docs` (doc_id, path, file_hash, text) are what the listing and extraction give; those whose digest is in `known`
    (doc_id, file_hash) are left alone.  Texts become numbered chunks of paragraphs, which replace all of their document's
    in `stored` (doc_id, content, chunk_idx, chunk_total, chunk_id, uuid).
    """
    fresh = changed(wanted_only(docs, wanted), known, "doc_id", "file_hash")
    hinted = filled(fresh, "path", policy=policy)
    new = numbered(hybrid(hinted).select("doc_id", "chunk_index", "content"), "doc_id", "chunk_index").drop("chunk_index")
    return replace_documents(stored, new, fresh), new
