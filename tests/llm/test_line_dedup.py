"""Line dedup against brute force, in one batch and in many, and its store."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tidewright.llm.line_dedup import LOWER, UPPER, LineRuns, keyed_lines, line_dedup, op11_line_dedup


def brute(rows, least=10):
    """``rows``: (doc_id, text)."""
    key = lambda line: re.sub(r"\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", line).translate(str.maketrans(UPPER, LOWER))
    first = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if d is not None and len(key(line)) >= least:
                first[key(line)] = min(d, first.get(key(line), d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(key(x)) < least or first[key(x)] == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", "kept").collect()), key=str)


ROWS = [
    (5, "A shared line of text\nown line of five\n\nshort"), (2, "  a SHARED line of text\t\nshort\nown line of two"), (9, "a shared line of text"), (7, None), (1, ""),
    (3, "twice in this one\ntwice in this one\r\nÄÖÜ äöü ẞẞẞẞ"), (4, "Äöü ÄÖÜ ẞẞẞẞ\näöü äöü ẞẞẞẞ\nTWICE in this ONE"), (8, "\n\n\n"), (6, "line of repeated id a\nmiddle line number"), (6, "line of repeated id b\nline of repeated id a"),
    (10, "line of repeated id a\nmiddle line number\n" + "x" * 200_000), (11, "x" * 200_000 + "\nnothing else here"), (None, "a shared line of text\nonly without an id"), (12, "only without an id"), (None, None),
    (13, "\n".join(f"a line of a long text {i % 3000}" for i in range(9000))), (14, "\n".join(f"a line of a long text {i}" for i in range(2990, 3010))), (15, "\x1cnot blank here\x1c"), (16, "not blank here"),
]


@pytest.mark.parametrize("batches", [1, 4])
def test_equals_brute_force(spark, batches):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("pos", F.lit("clash")).withColumn("h1", F.lit("clash"))
    assert got(line_dedup(docs, batches=batches)) == brute(ROWS)


def test_edge_rows_and_empty_table(spark, edge_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.select("doc_id", "text").collect()]
    assert got(line_dedup(edge_docs)) == brute(rows)
    assert line_dedup(no_docs).count() == 0


def test_query_equals_brute_force(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    want = [(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute(rows)]
    assert sorted((tuple(r) for r in op11_line_dedup(spark, small).collect()), key=str) == sorted(want, key=str)


def test_runs_are_levelled_sorted_and_read_without_a_shuffle(spark, tmp_path):
    store = LineRuns(spark, str(tmp_path / "runs"), buckets=4)
    docs = spark.range(0, 80).select(F.col("id").alias("doc_id"), F.concat(F.lit("a common line\nline number "), (F.col("id") % 60).cast("string")).alias("text"))
    levels = []
    for b in range(5):
        store.judge(keyed_lines(docs.where(F.floor(F.col("doc_id") / 16) == b)), str(b))
        levels.append([level for level, _ in store.state()[2]])
    assert levels == [[0], [1], [0, 1], [2], [0, 2]]
    keys = store.keys()
    assert keys.count() == keys.select("h1", "h2").distinct().count() == 61 and keys.agg(F.max("first")).first()[0] == 59
    name = store.state()[2][1][1]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = store.run(name).join(store.run(store.state()[2][0][1]).drop("first"), ["h1", "h2"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    store.close()


def test_batch_sent_again_and_store_opened_again(spark, tmp_path):
    path = str(tmp_path / "runs")
    docs = spark.createDataFrame([(1, "the first line here\nshared by these two"), (2, "shared by these two"), (3, "the first line here\nnew line of three")], "doc_id long, text string")
    first, later = keyed_lines(docs.where("doc_id < 3")), keyed_lines(docs.where("doc_id = 3"))
    store = LineRuns(spark, path)
    places = lambda df: sorted((r["doc_id"], r["pos"]) for r in df.collect())
    assert places(store.judge(first, "a")) == [(2, 0)]
    assert places(store.judge(later, "b")) == [(3, 0)]
    before = store.state()
    store.close()
    again = LineRuns(spark, path)
    assert again.state() == before
    assert places(again.judge(first, "a")) == [(2, 0)] and places(again.judge(later, "b")) == [(3, 0)]
    assert again.state() == before and again.keys().count() == 3
    again.close()
