import json

from driftwood.operators import indexing
from driftwood.sources import files
from driftwood.streaming.indexing import events


def test_files_become_chunks_and_a_second_run_reads_what_changed(spark, tmp_path):
    root = tmp_path / "docs"
    root.mkdir()
    for name, text in {"a+b_c.md": "One paragraph.\n\nAnother.", "empty-file.txt": " \n", "big.txt": "x" * 50, "scan.pdf": "page one has text|  |page three has text"}.items():
        (root / name).write_text(text)

    def docs():
        listed = files.listing(spark, str(root)).withColumn("mode", files.mode(files.F.col("size"), files.F.lit(None).cast("int"), head=30, name=49).alias("mode"))
        read = files.extract(files.contents(spark, listed, str(root)), {"pdf": lambda b: b.decode().split("|")})
        return listed.join(read.select("path", "text", "page_count", "ocr_pages"), "path").withColumn("file_hash", files.F.sha1("text"))

    first = docs()
    got = {r.path.rsplit("/", 1)[1]: r for r in first.collect()}
    assert got["big.txt"].text == "big.txt" and got["a+b_c.md"].text.startswith("One")
    assert got["scan.pdf"].text == "page one has text\n\npage three has text" and got["scan.pdf"].page_count == 3 and got["scan.pdf"].ocr_pages == [1]
    none = spark.createDataFrame([], "doc_id string, content string, chunk_idx int, chunk_total long, chunk_id string, uuid string")
    known = first.select("doc_id", "file_hash").limit(0)
    store, new = indexing.index_documents(first, none, known)
    store = store.select(none.columns)
    assert {r.chunk_id for r in store.collect()} == {f"{r.doc_id}_0" for r in got.values()}
    assert [r.content for r in store.collect() if r.doc_id == got["empty-file.txt"].doc_id] == [got["empty-file.txt"].path]
    (root / "a+b_c.md").write_text("New.")
    after, new = indexing.index_documents(docs(), store, spark.createDataFrame([(r.doc_id, r.file_hash) for r in got.values()], "doc_id string, file_hash string"))
    assert [r.content for r in new.collect()] == ["New."] and after.count() == 4
    assert indexing.index_documents(first, none, known, first.limit(0))[1].count() == 0
    assert indexing.index_documents(first, none, known, policy="skip")[1].count() == 3
    lines = [json.loads(r.value) for r in indexing.event_lines(new, "chunk", ["doc_id", "content"]).collect()]
    assert lines == [{"type": "chunk", "doc_id": got["a+b_c.md"].doc_id, "content": "New."}]
    assert events(indexing.event_lines(first, "block", ["doc_id", "text"])).where("type = 'block' and text is not null").count() == 4


def test_small_policies(spark):
    rows = spark.createDataFrame([("/b_c/d--e.txt",), ("/a",)], "path string")
    assert {r[0] for r in rows.select(files.name_hint(files.F.col("path"))).collect()} == {" b c d e.txt", " a"}
    assert [r.path for r in indexing.first_files(rows, 1).collect()] == ["/a"] and indexing.first_files(rows, 0).count() == 2
    assert files.joined_pages(["long enough text", None, "also long enough"], True, head=2) == ("long enough text", [1])
