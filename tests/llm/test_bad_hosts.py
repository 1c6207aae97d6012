"""A table on which the host verdict acts: the operator and its SQL drop sound documents of a bad host."""

import random

import pytest

from driftwood.llm import queries, sql

duckdb = pytest.importorskip("duckdb")


def test_sound_documents_of_a_bad_host_go(spark, tmp_path):
    rng = random.Random(2)
    good = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(80))
    rows = []
    for k in range(1200):
        host = f"host{k % 12}"
        bad = rng.random() < (0.9 if host == "host3" else 0.08)
        rows.append((k, "too short" if bad else good(), "en", host, 0))
    rows += [(5000, good(), "en", None, 0), (5001, None, "en", "host3", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op3_quality(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(sql.ORACLE["op3_quality"])
    names = [d[0] for d in want.description]
    mine = got.select(names).collect()
    assert sorted(map(repr, map(tuple, mine))) == sorted(map(repr, want.fetchall()))
    host = {r[0]: r[3] for r in rows}
    failed = {host[r.doc_id] for r in mine if r.host_failed}
    assert failed == {"host3"}
    assert [r for r in mine if host[r.doc_id] == "host3" and not r.base_failed] and not any(r.kept for r in mine if host[r.doc_id] == "host3")
