"""Rows without text weigh something, and rows of one doc_id are more than one task's work."""

from pyspark.sql import functions as F

from driftwood.llm import binary_ids, exchange


def test_a_million_empty_rows_are_many_groups(spark):
    rows = spark.range(1_000_000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    total = exchange.text_bytes(rows, row=exchange.ROW_BYTES)
    assert exchange.text_bytes(rows) == 0 and total == 64_000_000 and exchange.parts_of(total, exchange.BLOCK_BYTES) > 4
    assert exchange.text_bytes(rows.limit(0), row=exchange.ROW_BYTES) == 0


def test_rows_of_one_id_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(binary_ids, "TASK_BYTES", 2_000)
    docs = spark.range(300).select(F.when(F.col("id") < 200, 7).cast("long").alias("doc_id"), F.concat(F.lit("text of row "), F.col("id").cast("string")).alias("text"))
    binary_ids.write_ids(docs, str(tmp_path / "ids"))
    got = binary_ids.read_ids(spark, str(tmp_path / "ids")).orderBy("start").collect()
    assert spark.read.parquet(str(tmp_path / "ids/chunks")).select("shard").distinct().count() > 3
    assert [r.doc_id for r in got] == [None] * 100 + [7] * 200
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(300)]
