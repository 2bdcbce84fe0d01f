import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from simloom.llm import warc
from simloom.llm.queries import oracle_sql, queries

BIG = "x" * 500
FAKE = "a" * 50 + "WARC/1.0\r\nWARC-Type: response\r\nX-Page-Id: 999\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" + "b" * 60
PAGES = [
    (1, "u", FAKE), (2, "u\r\nv", None), (3, None, ""), (4, "u", BIG), (5, "u", BIG), (6, "u", BIG + "WARC/1.0\r\n"), (7, "x", "WARC/1.0\r\n\r\n" * 30),
    (8, "e", "é" * 200), (9, "e", "é" * 200), (10, "z", "WARC/1.0\r\nContent-Length: 100000\r\n\r\n" + "q" * 300), (11, "s", "short"), (12, "s", "short"), (13, "m", "WARC/1.0\r\n"), (14, "n", "\r\n\r\n"),
]


def expected(rows):
    first = {}
    for i, _, h in sorted(rows):
        first.setdefault(h or "", i)
    out = {}
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 100 and first[h or ""] != i
        out[i] = (len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h or ""] if again else None)
    return out


@pytest.mark.parametrize("split", ["128m", "900"])
def test_round_trip(spark, split):
    """Payloads with magic, headers and whole records in them, also where files are cut anywhere."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
        got = warc.round_trip(df.coalesce(1)).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == expected(PAGES)
    assert len(got) == len(PAGES) and all(r.digest_ok for r in got if r.record_type == "response")


@pytest.mark.parametrize("split", ["128m", "60000"])
def test_payloads_of_several_cells(spark, split):
    """Payloads longer than the cells in which pieces meet, with magic and whole records in them, beside plain long ones."""
    long = "".join(f"{k} some page text, {FAKE if k % 400 == 7 else ''}" for k in range(8_000))
    assert len(long) > 2 * warc.CELL
    pages = [(1, "u", long), (2, "u", "z" * 150_000), (3, "v", long), (4, "w", "y" + long), (5, "w", "WARC/1.0\r\n" * 20_000)]
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == expected(pages)
    assert all(r.digest_ok for r in got if r.record_type == "response")


def test_warc_edges(spark):
    schema = "page_id long, url string, html string, _digest string"
    rows = [(1, "u", BIG, "x"), (1, "u", BIG, "x"), (None, "u", BIG, "x"), (None, None, None, None)]
    got = sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in warc.round_trip(spark.createDataFrame(rows, schema)).collect())
    assert got == [("1", "response", "None"), ("1", "revisit", "1"), ("None", "response", "None"), ("None", "revisit", "1")]
    assert warc.round_trip(spark.createDataFrame([], schema)).count() == 0


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf)
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert 0 < out.count() <= n and out.select("doc_id").distinct().count() == out.count()
    assert [s for s, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "decontamination", "mixing"]


def test_stages_on_edges(spark, edge_docs, no_docs):
    """With clashing columns, which all stages but the last hand on as they are."""
    docs = edge_docs
    for name in ("n_deleted", "n_lines", "_many", "_first", "_runs", "keep", "_all"):
        docs = docs.withColumn(name, F.concat(F.lit(name), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.count() <= docs.count()
        if name != "mixing":
            assert out.columns == docs.columns
            others = [c for c in docs.columns if c not in ("text", "n_chars")]
            assert out.select(others).exceptAll(docs.select(others)).count() == 0
            # texts without words stay
            assert out.filter("text IS NULL OR NOT text RLIKE '[a-zA-Z]'").count() == 3
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0


def test_of_rows_that_repeat_the_same_one_stays(spark):
    passage = " ".join(f"word{k}" for k in range(60))
    rows = [(1, passage, s, s, len(s)) for s in ("c", "a", "b", "a")] + [(2, "something else altogether, which is short", "x", "y", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    for name in ("line_dedup", "jaccard_join"):
        got = [sorted(tuple(r) for r in stages[name](spark, docs.repartition(parts), "").collect()) for parts in (1, 3)]
        assert got[0] == got[1] and set(got[0]) <= set(rows) and [r[0] for r in got[0]] == [1, 2]


def test_registered():
    names = queries()
    assert {n.split("_")[0] for n in names} == {"pipeline", *(f"op{k}" for k in range(1, 11))}
    assert set(oracle_sql()) <= set(names)
