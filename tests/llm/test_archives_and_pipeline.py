"""WARC round trips over byte ranges, URL rules and tree, SQL statements, the pipeline."""

from __future__ import annotations

import gzip
import os
import random
import uuid

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from commune.llm import simhash, urltree, warc
from commune.llm.common import table
from commune.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


# --- WARC ------------------------------------------------------------------------------------

def test_archives_are_plain_gzip_and_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "x" * 200), (2, "http://b/\r\nEvil: 1", "x" * 200), (3, None, None), (4, "u", ""),
            (5, "u", "é" * 60), (6, "u", "é" * 60), (7, "u", "short"), (8, "u", "short"), (None, "u", "x" * 200),
            (1, "again", "x" * 200), (9, "u", "z" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    path = str(tmp_path / "w")
    warc.write_archives(pages, path)
    text = b"".join(gzip.open(f"{path}/{f}").read() for f in sorted(os.listdir(path)) if f.startswith("part"))
    assert text.count(b"WARC/1.1\r\n") == len(rows)
    got = sorted(warc.digest_rows(warc.records(spark, path)).collect(), key=lambda r: (r.page_id is None, r.page_id or 0))
    assert [(r.page_id, r.record_type, r.refers_to) for r in got] == [
        (1, "response", None), (1, "response", None), (2, "revisit", 1), (3, "response", None), (4, "response", None),
        (5, "response", None), (6, "revisit", 5), (7, "response", None), (8, "response", None), (9, "response", None),
        (None, "revisit", 1)]
    assert [r.payload_bytes for r in got][:3] == [200, 200, 200]
    assert {r.payload_digest for r in got if r.page_id in (3, 4)} == {warc.sha256(b"")}
    warc.write_archives(pages.limit(0), str(tmp_path / "none"))
    assert warc.records(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("split", [64, 300, 1000, 100_000])
def test_reader_owns_records_across_byte_ranges(spark, tmp_path, split):
    """Stored (uncompressed) members full of magic bytes, cut into ranges of any size."""
    rnd = random.Random(split)
    payloads = {}
    with open(tmp_path / "a.warc", "wb") as f:
        for k in range(60):
            parts = [warc.MAGIC, warc.MAGIC + b"\x00" * 7, b"WARC/1.1", bytes([rnd.randrange(256)]) * 3, b"\x1f", b"\x8b"]
            body = b"".join(rnd.choice(parts) for _ in range(rnd.randrange(60)))
            payloads[k] = body
            f.write(gzip.compress(warc.record(k, "u", body, warc.sha256(body), None), compresslevel=rnd.choice([0, 6])))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        got = warc.records(spark, str(tmp_path / "a.warc")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r.page_id: bytes(r.payload) for r in got} == payloads
    assert len(got) == len(payloads)


# --- URLs ------------------------------------------------------------------------------------

def test_url_rules(spark):
    urls = ["http://Example.NET/en/1", "https://a.example.net/de/1", "http://net/", "http://notexample.net", "x://org/fr/",
            "http://a.org/fr", "http://www.example.com/de/x?y#z", "http://example.com/en/", None, "no scheme", "",
            "http://h/p?q://x/y", "HTTP://É.org/fr/é"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r.page_id: r for r in urltree.judge(pages).collect()}
    assert [(got[k].host, got[k].path, got[k].rule) for k in range(len(urls))] == [
        ("example.net", "/en/1", "example.net/en/"), ("a.example.net", "/de/1", "net/"), ("net", "/", "net/"),
        ("notexample.net", "", None), ("org", "/fr/", "org/fr/"), ("a.org", "/fr", None),
        ("www.example.com", "/de/x", "example.com/de/"), ("example.com", "/en/", None), ("", "", None), ("", "", None),
        ("", "", None), ("h", "/p", None), ("É.org", "/fr/é", "org/fr/")]
    assert got[1].verdict == "block" and got[0].verdict == "allow" and got[7].verdict == "allow"
    assert urltree.judge(pages.limit(0)).count() == 0


def test_url_tree_rejects_labelled_templates_only(spark):
    rows = [("h", f"/spam/{k}", 1) for k in range(12)] + [("h", f"/spam/{k}", None) for k in range(12, 20)]
    rows += [("h", f"/good/{k}", 0) for k in range(12)] + [("h", f"/none/{k}", None) for k in range(9)]
    rows += [("h", f"/junk/{k}", 1) for k in range(12)] + [("g", f"/spam/{k}", None) for k in range(5)]
    rows += [("wide", f"/{chr(97 + k % 26)}{chr(97 + k // 26)}", 0) for k in range(600)]
    tree = urltree.build_tree(spark.createDataFrame(rows, "host string, path string, label int")).collect()
    at = {(r.host, r.path_key): r for r in tree}
    assert at["h", "/spam/#"].rejected and at["h", "/junk/#"].template == at["h", "/spam/#"].template
    assert not at["h", "/good/#"].rejected and not at["h", "/none/#"].rejected and not at["g", "/spam/#"].rejected
    assert at["h", "/none/#"].template != at["h", "/spam/#"].template
    assert len({r.template for r in tree if r.host == "wide"}) == 1


def test_url_join_is_the_same_beyond_the_broadcast_bound(spark, monkeypatch):
    key = lambda df: sorted(map(repr, df.collect()))
    small = key(urltree.query(spark, SF))
    monkeypatch.setattr(urltree, "BROADCAST_ROWS", 0)
    assert key(urltree.query(spark, SF)) == small


# --- registry and pipeline -------------------------------------------------------------------

@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    res = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in res.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(*cols).collect()) == want


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_pipeline_stages_take_effect(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.withColumn("score", F.lit(uuid.uuid4().hex)), SF)
        if name != "sentencepiece":
            assert out.columns == [*columns, "score"]
            out = out.drop("score")
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] == counts[-2] > 0
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    after = spark.read.parquet(str(tmp_path / "simhash_near_dedup"))
    assert all(r.doc_id == r.component_id for r in simhash.components(after).collect())
    assert {(r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, SF).collect()} == {
        (r.doc_id, tuple(r.ids)) for r in docs.collect()} and len(ids) == counts[-1]


def test_stages_keep_empty_tables_and_null_rows(spark):
    docs = table(spark, SF, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (7, "", "en", "s", 0), (7, "", "en", "s", 0)],
                                docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        assert stage(spark, odd, SF).count() <= 3
