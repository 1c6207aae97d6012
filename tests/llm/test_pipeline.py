import pytest

pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        docs = pipeline.exchange.staged(out, name)
    assert whole / 2 < docs.count() <= whole
    pieces = pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_copies_and_passages_go(spark):
    base = [" ".join(f"{a}{b}x{k}" for a in "abcdefghij" for b in range(9)) for k in range(3)]
    passage = " ".join(f"p{k}" for k in range(60))
    own = [" ".join(f"{x}{k}" for k in range(50)) for x in "uv"]
    texts = [*base, base[0], base[1] + " more", passage + " " + own[0], own[1] + " " + passage, None, ""]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = pipeline.keep_one_of_near_copies(spark, docs, SF)
    assert {r.doc_id for r in kept.collect()} == {0, 1, 2, 5, 6, 7}
    cut = {r.doc_id: r for r in pipeline.cut_repeated_passages(spark, kept, SF).collect()}
    assert cut[6].text == own[1] and cut[6].n_chars == len(own[1]) and cut[5].text == texts[5] and cut[7].text is None and cut[6].lang == "en"
