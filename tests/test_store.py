import hashlib
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from driftwood.jobs import registry
from driftwood.operators import retrieval, store
from driftwood.sources import files
from driftwood.streaming import indexing

SF = "/root/testdata/sf0.001"


def test_fusion_ties_go_to_the_dense_list(spark):
    dense = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "id string, dense_rank long")
    sparse = spark.createDataFrame([("c", 0), ("d", 1)], "id string, sparse_rank long")
    rows = retrieval.fuse(dense, sparse, "id").orderBy(*retrieval.fused_order()).collect()
    assert [r.id for r in rows] == ["c", "a", "b", "d"]
    assert rows[0].rrf == pytest.approx(1 / 63 + 1 / 61)


def test_plan_upsert_and_complete(spark):
    listed = spark.createDataFrame([("a", 5), ("b", 1), ("c", 1)], "doc_id string, mtime long")
    known = spark.createDataFrame([("a", 1), ("a", 3), ("b", 1), (None, 9)], "doc_id string, mtime long")
    plan = store.incremental_plan(listed, store.indexed_state(known, "doc_id", "mtime"), "doc_id", "mtime")
    assert {r.doc_id: r.action for r in plan.collect()} == {"a": "REINDEX", "b": "SKIP", "c": "NEW"}
    rows = store.upsert(spark.createDataFrame([(1, 1, "old"), (2, 1, "stays")], "id long, v long, x string"), spark.createDataFrame([(1, 1, "new")], "id long, v long, x string"), "id", ["v"])
    assert {r.id: r.x for r in rows.collect()} == {1: "new", 2: "stays"}
    parts = spark.createDataFrame([("a", 2), ("a", 2), ("b", 2), ("c", 0), ("d", None)], "doc_id string, total long")
    assert [r.doc_id for r in store.complete(parts, "doc_id", "total").collect()] == ["a"]


def test_listing_and_extraction(spark, tmp_path):
    for name in ("a.md", "sub/b.txt", ".hidden.md", ".dir/x.md", "~$lock.docx", "node_modules/q.txt", "empty.md", "with space é.txt", "a+b 100%.md", "vendor/x.md", "sub/htmlcov/y.md", "no.bin"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("" if name == "empty.md" else "hello\n\nworld")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="u"><w:p><w:t>one</w:t></w:p><w:p><w:t> </w:t></w:p><w:p><w:t>two</w:t></w:p></w:document>')
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    got = {Path(r.path).name: r for r in files.listing(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.md", "b.txt", "with space é.txt", "a+b 100%.md", "d.docx", "bad.docx"}
    assert all(r.path == str(tmp_path / Path(r.path).relative_to(tmp_path)) and Path(r.path).exists() and r.doc_id == hashlib.sha1(r.path.encode()).hexdigest() for r in got.values())
    assert {Path(r.path).name for r in files.listing(spark, f"file://{tmp_path}").collect()} == set(got)
    assert got["a.md"].doc_type == "md" and got["a.md"].mode == "full"
    texts = {Path(r.path).name: r for r in files.extract(spark.read.format("binaryFile").load(f"{tmp_path}/*.docx")).collect()}
    assert texts["d.docx"].text == "one\n\ntwo" and texts["bad.docx"].text == "" and texts["bad.docx"].error
    mib = 1 << 20
    rows = spark.createDataFrame([(60 * mib, None), (50 * mib, None), (20 * mib, 30), (5 * mib, 40)], "size long, pages int").select(files.mode(F.col("size"), F.col("pages")).alias("m")).collect()
    assert [r.m for r in rows] == ["filename_only", "head_only", "full", "head_only"]


def test_stream_upserts_like_a_batch(spark, tmp_path):
    source = tmp_path / "in"
    for k in range(3):
        spark.createDataFrame([(k, k, f"v{k}"), (0, k, f"w{k}")], "id long, v long, x string").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("id long, v long, x string").option("maxFilesPerTrigger", 1).parquet(str(source))
    indexing.index_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck"), "id", ["v", "x"]).awaitTermination(120)
    last = max(int(p.name) for p in (tmp_path / "out").iterdir())
    assert sorted((r.id, r.x) for r in spark.read.parquet(str(tmp_path / "out" / str(last))).collect()) == [(0, "w2"), (1, "v1"), (2, "v2")]


def test_events_and_sessions(spark):
    lines = spark.createDataFrame([('{"type":"file","path":"p"}',), ('{"error":"x"}',), ("nonsense",)], "value string")
    assert sorted(r.type for r in indexing.events(lines).collect()) == ["error", "file", "malformed"]
    beats = spark.createDataFrame([("w", t) for t in (0, 10, 35, 100)], "worker string, t long").select("worker", F.timestamp_seconds("t").alias("ts"))
    assert sorted(r.n for r in indexing.sessions(beats, "worker", "ts").collect()) == [1, 3]


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_queries_run(spark, name):
    rows = registry.QUERIES[name](spark, SF)
    assert rows.count() >= 0 and len(set(rows.columns)) == len(rows.columns)


def test_queries_match_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "events", "labels", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    for name in ("chunk_fixed_window", "sentence_split", "hybrid_search", "semantic_boundaries", "incremental_plan"):
        mine, sql = registry.QUERIES[name](spark, SF), con.execute(registry.ORACLE[name])
        columns = [d[0] for d in sql.description]
        assert sorted(columns) == sorted(mine.columns)
        assert sorted(map(str, map(tuple, mine.select(columns).collect()))) == sorted(map(str, sql.fetchall())), name
