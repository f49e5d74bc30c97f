"""Validation gates, loads, schema, reports, mapping."""

import random

import pytest
from pyspark.sql import functions as F

from tidewright.operators import load, mapping, names, report, schema, steps, validate
from tidewright.plans.spec import FileTypeSpec, spec_rows


@pytest.mark.parametrize("bad,severity,valid", [(0, "ignored", True), (1, "ignored", True), (2, "warning", True), (10, "warning", True), (11, "issue", False)])
def test_gate(spark, bad, severity, valid):
    df = spark.range(100).select(F.when(F.col("id") < bad, "x").otherwise("1").alias("n"))
    found = validate.issues(df, [validate.numeric("n")])
    assert found.first().severity == severity and validate.gate(found).first().is_valid == valid
    assert validate.summary(found).first().is_valid == valid


def test_no_rows_are_invalid(spark):
    df = spark.createDataFrame([], "n string, d string")
    checks = [validate.numeric("n"), validate.dates("d")]
    assert not validate.gate(validate.issues(df, checks)).first().is_valid
    assert validate.examples(df, checks).count() == 0 and validate.null_columns(df, ["n"]).first().all_null


def test_validation_has_one_exchange_and_conversion_none(spark, small):
    from tidewright import queries as Q

    rows = Q.staged(spark, small, "lineitem")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(validate.issues(rows, validate.checks_for(Q.LINEITEM))).count("Exchange ") == 1
    typed = Q.convert.typed_select(rows, Q.LINEITEM)
    assert "Exchange" not in plan(typed)
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_extendedprice:double,l_shipdate:timestamp_ntz>" in plan(typed)


def test_bad_good_and_blank_make_all(spark, small):
    from tidewright import queries as Q

    rows = Q.staged(spark, small, "lineitem")
    found = validate.issues(rows, [validate.numeric("quantity")]).first()
    typed = rows.select(Q.convert.to_float(F.col("quantity")).alias("v"), F.nullif(Q.clean.clean_numeric(F.col("quantity")), F.lit("")).alias("c"))
    assert found.error_count + typed.where("v is not null").count() + typed.where("c is null").count() == found.total


def upsert_rows(spark, rows):
    return spark.createDataFrame(rows, "id string, v string").withColumn("_upsert_hash", F.when(F.col("id").isNotNull(), load.key_hash(["id"])))


def test_upsert(spark, tmp_path):
    target, staged = upsert_rows(spark, [("1", "a"), ("2", "b"), (None, "z")]), upsert_rows(spark, [("2", "c"), ("2", "d"), ("3", "e")])
    want = [("1", "a"), ("2", "c"), ("2", "d"), ("3", "e"), (None, "z")]
    rows = lambda df: sorted(((r.id, r.v) for r in df.collect()), key=str)
    assert rows(load.upsert(target, staged)) == sorted(want, key=str)
    assert rows(load.upsert(load.upsert(target, staged), staged)) == sorted(want, key=str)
    table = load.VersionedTable(spark, f"file://{tmp_path}/t")
    assert table.read() is None
    table.load(target, "upsert", ["id"])
    table.load(staged, "upsert", ["id"])
    assert rows(table.read()) == sorted(want, key=str) and table.version() == 1
    table.load(staged, "replace")
    assert table.read().count() == 3
    assert rows(load.not_replaced(target, staged, broadcast_hashes=0)) == [("1", "a"), (None, "z")]


def test_key_hash_ignores_outer_spaces_and_guard_counts_nulls(spark):
    df = spark.createDataFrame([(" a ", "b"), ("a", "b"), (None, "b"), ("a|b", "c"), ("a", "b|c")], "k string, l string")
    h = [r[0] for r in df.select(load.key_hash(["k", "l"])).collect()]
    assert h[0] == h[1] != h[2] and h[3] == h[4]
    s = [r[0] for r in df.select(load.key_hash(["k", "l"], safe=True)).collect()]
    assert s[3] != s[4]
    assert load.key_guard(df, ["k"]).first().null_keys == 1
    with pytest.raises(ValueError):
        load.key_guard(df, ["nope"])


def test_newest_file_wins_equals_the_loop(spark):
    r = random.Random(5)
    for _ in range(3):
        files = [(m, f"f{m}_{j}", r.random() > 0.2, [(str(r.randint(1, 5)), f"{m}{j}{k}") for k in range(r.randint(1, 5))]) for m in range(3) for j in range(2)]
        state = []
        for _, _, ok, rows in sorted(files):
            if ok:
                keys = {k for k, _ in rows}
                state = [x for x in state if x[0] not in keys] + rows
        flat = [(m, f, ok, k, v) for m, f, ok, rows in files for k, v in rows]
        df = spark.createDataFrame(flat, "mtime int, _source_file string, ok boolean, id string, v string").withColumn("_upsert_hash", load.key_hash(["id"]))
        assert sorted((x.id, x.v) for x in load.newest_file_wins(df, valid=F.col("ok")).collect()) == sorted(state)


def test_schema_diff_and_inference(spark):
    df = spark.createDataFrame([("1", "1.5", "true", "x", "31/12/2023", None), ("2", "2", "false", "1", "01/01/2024", None)], "i string, f string, b string, t string, d string, n string")
    got = {r.column: r.inferred for r in schema.infer_types(df, find_dates=True).collect()}
    assert got == {"i": "INT", "f": "FLOAT", "b": "INT", "t": "NVARCHAR(MAX)", "d": "DATETIME", "n": "NVARCHAR(MAX)"}
    spec = schema.spec_from(schema.infer_types(df), "new")
    diff = schema.schema_diff(spark, spec.schema(), FileTypeSpec("x", {"i": "i", "f": "f", "z": "z"}, {"i": "FLOAT", "f": "NVARCHAR(MAX)"}).schema())
    assert {r.column: r.action for r in diff.collect()} == {"i": "alter", "f": "recreate", "b": "drop", "t": "drop", "d": "drop", "n": "drop", "z": "add"}
    assert schema.needs_recreate(diff) and schema.schema_warnings(diff).count() == 3


def test_detection_prefers_first_row_then_score_then_name(spark):
    specs = spec_rows(spark, [FileTypeSpec("b", {"X": "x1", "Y": "y1"}), FileTypeSpec("a", {"X": "x2", "Y": "y2"}), FileTypeSpec("c", {"P": "p1", "Q": "q1"})])
    headers = spark.createDataFrame([("f1", 0, " x"), ("f1", 0, "Y"), ("f1", 1, "p"), ("f1", 1, "q"), ("f2", 0, "title"), ("f2", 1, "p"), ("f2", 1, "q"), ("f3", 0, "none")], "path string, header_row int, cell string")
    got = {r.path: (r.header_row, r.file_type, r.score) for r in names.detect_file_type(headers, specs).collect()}
    assert got == {"f1": (0, "a", 1.0), "f2": (1, "c", 1.0)}
    files = spark.createDataFrame([("/d/Sales_B.csv",), ("/d/zzz.csv",)], "path string")
    types = spark.createDataFrame([("sales",), ("b",)], "file_type string")
    assert [tuple(r) for r in names.detect_by_filename(files, types).collect()] == [("/d/Sales_B.csv", "b")]
    assert [r[0] for r in files.select(names.type_from_letters(F.col("path"))).collect()] == ["Sales_B", "zzz"]


def test_drift_scores_each_pair_of_names_once(spark, monkeypatch):
    """Pairs of files are gone before scores are made, so no filter can move the scoring below them."""
    plans, score = [], mapping.score_pairs
    monkeypatch.setattr(mapping, "score_pairs", lambda pairs, *a: plans.append(pairs._jdf.queryExecution().optimizedPlan().toString()) or score(pairs, *a))
    rows = [("a", "total", "missing"), ("a", "totals", "extra"), ("a", "xyz", "extra"), ("b", "total", "missing"), ("c", "total", "missing"), ("c", "totals", "extra")]
    got = mapping.drift_report(spark.createDataFrame(rows, "path string, column string, problem string"), renormalize=True).collect()
    assert {(r.path, r.missing, r.extra) for r in got} == {("a", "total", "totals"), ("b", "total", None), ("c", "total", "totals")}
    assert len(plans) == 1 and "Join" not in plans[0]


def test_reports(spark):
    results = spark.createDataFrame([("a", "success", 1.0), ("a", "failed", 2.0), ("b", "success", 3.0)], "file_type string, status string, elapsed_s double")
    got = {r.file_type: (r.files, r.successes, r.failures, r.success_rate) for r in report.load_summary(results).collect()}
    assert got == {"a": (2, 1, 1, 50.0), "b": (1, 1, 0, 100.0), "ALL": (3, 2, 1, 66.7)}
    assert [tuple(r)[:4] for r in report.load_summary(results.where("false")).select("file_type", "files", "successes", "failures").collect()] == [("ALL", 0, 0, 0)]
    plan = report.archive_plan(spark.createDataFrame([("/d/a.csv", False), ("/d/b.csv", True)], "path string, taken boolean"), "2024-01-02", "20240102_030405")
    assert [r.destination for r in plan.orderBy("path").collect()] == ["/d/2024-01-02/a.csv", "/d/2024-01-02/b_20240102_030405.csv"]
    df = spark.createDataFrame([(1, "x"), (1, "y"), (1, None)], "n int, s string")
    for exact in (True, False):
        p = {r.column: r for r in report.column_profile(df, exact=exact).collect()}
        assert p["n"].low_cardinality and not p["s"].low_cardinality and p["n"].least == 1.0 and p["s"].least is None


def _own_orders(spark, tmp_path, n):
    """Orders as one row group, and what SQL says of them."""
    import duckdb

    from tidewright import queries as Q

    path = f"{tmp_path}/orders.parquet"
    rows = spark.sql(f"select id as o_orderkey, id % 7 as o_custkey, element_at(array('F', 'O', 'P'), int(id % 3) + 1) as o_orderstatus, double(id) as o_totalprice, timestamp_ntz'1995-01-01 00:00:00' as o_orderdate, '1-URGENT' as o_orderpriority from range({n})")
    rows.coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{path}/*.parquet'")
    return lambda name: (sorted(map(tuple, Q.QUERIES[name](spark, str(tmp_path)).collect()), key=str), sorted(con.execute(Q.SQL[name]).fetchall(), key=str))


def test_precheck_of_a_table_of_any_size(spark, tmp_path):
    """A file of over 100 MB is a warning of the operator; the query's sizes are made up from rows."""
    got, want = _own_orders(spark, tmp_path, 600_000)("file_precheck")
    assert got == want
    big = spark.createDataFrame([("/a.csv", "orders", report.LARGE_FILE + 1)], "path string, file_type string, size_bytes long")
    none = spark.createDataFrame([], "path string, column string, problem string")
    assert [r.problem for r in report.file_precheck(big, none, "orders").collect()] == ["large"]
    assert report.file_precheck(big, none, "orders", large=None).isEmpty()


@pytest.mark.parametrize("name", ["load_folder_report", "load_guarded_report"])
def test_load_reports_do_not_show_how_the_table_was_split(spark, tmp_path, name):
    """The first task reads a part of the file in which no row group begins."""
    run = _own_orders(spark, tmp_path, 400)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert spark.read.parquet(f"{tmp_path}/orders.parquet").where(F.spark_partition_id() == 0).isEmpty()
        got, want = run(name)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want


def test_mapping(spark):
    src = spark.createDataFrame([("Order Date",), ("Prod Name",)], "source_column string")
    tgt = spark.createDataFrame([("order_date",), ("order date",), ("product name",)], "target_column string")
    got = mapping.suggest_mappings(src, tgt, renormalize=True)
    best = {r.source_column: r.target_column for r in got.where("rank = 1").collect()}
    assert best["Order Date"] == "order date"
    plain = mapping.suggest_mappings(src, tgt)
    assert max(r.confidence for r in plain.collect()) <= 50.0 and mapping.auto_map(plain).count() == 0
    assert mapping.auto_map(got, 70).count() >= 1
    specs = spec_rows(spark, [FileTypeSpec("orders", {"Order Date": "d", "Amount": "a"})])
    types = mapping.suggest_file_type(spark.createDataFrame([("Order Date",), ("Amounts",)], "column string"), specs)
    assert types.first().file_type == "orders" and types.first().confidence == 100.0
    renamed, plan = mapping.auto_rename(spark.createDataFrame([(1, 2)], "`Order Date` int, Amounts int"), specs, "orders", renormalize=True)
    assert renamed.columns[0] == "d" and plan.count() == 2
    vec = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), (None, [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in vec.select(mapping.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]


def test_steps(spark):
    df = spark.range(10)
    assert steps.process(df, [lambda d: d.where("id > 4"), lambda d: d.limit(3)]).count() == 3
    assert steps.process_in_chunks(df, lambda b: b.assign(x=b["id"] * 2), "id long, x long").agg(F.sum("x")).first()[0] == 90


def test_numbers_across_partitions(spark):
    df = spark.range(100).select((99 - F.col("id")).alias("k")).repartition(7)
    assert all(r.k + 1 == r._row_num for r in validate.numbered(df, "k").collect())


def test_nearest_vectors(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, 0.1])], "id long, vector array<double>")
    for chunk, few in ((1, 0), (100, 0), (1, 10)):
        got = mapping.nearest_vectors(rows.where("id in (0, 3)"), rows, 2, chunk, few=few).orderBy("query_id", F.desc("score"), "id").collect()
        assert [(r.query_id, r.id) for r in got] == [(0, 1), (0, 5), (3, 0), (3, 1)] and got[2].score == 0.0
    assert mapping.nearest_vectors(rows.where("false"), rows).count() == 0


def test_context_and_meaning(spark):
    df = spark.createDataFrame([("Order No", "คำสั่ง"), ("หมายเลข 1", "หมายเลข 2"), ("shopee x", "y"), ("a", "b")], "a string, b string")
    col = lambda t: [r[0] for r in df.select(mapping.context_similarity(F.col("a"), F.col("b"), t)).collect()]
    assert col("") == [0.5, 0.5, 0.0, 0.0] and col("my_JST") == [0.5, 0.8, 0.0, 0.0] and col("shopee") == [0.5, 0.5, 0.2, 0.0]
    assert df.select(mapping.semantic_text(F.lit("Order-Date (id)"))).first()[0] == "Order Date id identifier number date time"


def test_append_writes_only_new_rows(spark, tmp_path):
    table = load.VersionedTable(spark, f"file://{tmp_path}/t")
    first = spark.createDataFrame([(1, "a")], "id long, v string")
    more = spark.createDataFrame([(2, "b", 3)], "id long, v string, extra long")
    table.append(first, "one")
    parts = {p.name for p in (tmp_path / "t").iterdir()}
    table.append(more, "two")
    assert table.append(more, "two") == table.version() == 1  # a replayed batch
    assert sorted(map(tuple, table.read().select("id", "v", "extra").collect())) == [(1, "a", None), (2, "b", 3)]
    assert parts <= {p.name for p in (tmp_path / "t").iterdir()} and table.committed("one") and not table.committed("three")


def test_rows_without_a_hash_stay_out_of_the_shuffle(spark):
    rows = spark.createDataFrame([(None, 1, "f", i) for i in range(50)] + [(b"k", 1, "f", 1), (b"k", 2, "g", 2)], "_upsert_hash binary, mtime long, _source_file string, v long")
    got = load.newest_file_wins(rows)
    assert got.count() == 51 and got.where("_upsert_hash is not null").collect()[0].v == 2


def _files(folder):
    return {str(p.relative_to(folder)): (p.stat().st_mtime_ns, p.stat().st_size) for p in folder.rglob("_bucket=*/*.parquet")}


def test_an_upsert_reads_and_writes_only_the_buckets_that_it_touches(spark, tmp_path):
    rows = lambda lo, hi, v: spark.range(lo, hi).select(F.col("id").cast("string").alias("id"), F.lit(v).alias("v")).withColumn("_upsert_hash", load.key_hash(["id"]))
    table = load.VersionedTable(spark, f"file://{tmp_path}/t", buckets=32)
    table.upsert(rows(0, 2000, "a"))
    before = _files(tmp_path / "t")
    table.upsert(rows(0, 3, "b"))
    after = _files(tmp_path / "t")
    assert {k: after[k] for k in before} == before
    touched = set(table.log()[-1]["replaced"])
    assert 1 <= len(touched) <= 3 and {int(k.split("_bucket=")[1].split("/")[0]) for k in set(after) - set(before)} == touched
    assert sum(v[1] for k, v in after.items() if k not in before) < sum(v[1] for v in before.values()) / 5
    # the next one lists only the live folders of its bucket
    log = table.log()
    one = {next(iter(touched))}
    assert all(p.endswith(f"/_bucket={b}") for b in one for paths in table.folders(log, one).values() for p in paths)
    got = {r.id: r.v for r in table.read().collect()}
    assert len(got) == 2000 and [got[str(i)] for i in range(5)] == ["b", "b", "b", "a", "a"]
    table.append(rows(5000, 5001, "c"))
    table.upsert(rows(5000, 5001, "d"))
    table.compact()
    assert table.read().count() == 2001 and len(table.folders(table.log())) == 1 and table.read().where("v = 'd'").count() == 1


def test_a_log_names_each_part_once(spark, tmp_path):
    table = load.VersionedTable(spark, f"file://{tmp_path}/t")
    for i in range(6):
        table.append(spark.createDataFrame([(i,)], "i int"), str(i))
    log = table.log()
    assert [r["version"] for r in log] == list(range(6)) and len({r["part"] for r in log}) == 6 and table.read().count() == 6
    empty = spark.createDataFrame([], "i int")
    assert table.append(empty, "none") == 6 and table.read().count() == 6
    assert table.replace(empty) == 7 and table.read().count() == 0 and table.read().columns == ["i"]


def test_types_widen(spark):
    from pyspark.sql import types as T

    schema_of = lambda text: T._parse_datatype_string(text)
    got = load.evolved(schema_of("a int, b date, c double, d string, e int, f boolean"), schema_of("x int, a bigint, b timestamp_ntz, c int, d int, e date, f boolean"))
    assert [(f.name, f.dataType.simpleString()) for f in got] == [("a", "bigint"), ("b", "timestamp_ntz"), ("c", "double"), ("d", "string"), ("e", "string"), ("f", "boolean"), ("x", "int")]


def test_a_hot_key_is_not_shuffled_to_one_task(spark):
    """Nine rows in ten share a key; no adaptive execution."""
    rows = spark.range(0, 40_000, numPartitions=8).select(F.when(F.col("id") % 10 > 0, 0).otherwise(F.col("id")).cast("string").alias("k"), (F.col("id") % 3).alias("mtime"), F.concat(F.lit("f"), F.col("id") % 3).alias("_source_file"))
    rows = rows.withColumn("_upsert_hash", load.key_hash(["k"]))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        kept = load.newest_file_wins(rows, hot_share=100)
        per_task = [r["count"] for r in kept.groupBy(F.spark_partition_id()).count().collect()]
        want = rows.join(rows.groupBy("k").agg(F.max("mtime").alias("m")), "k").where("m = mtime").count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(per_task) == want and max(per_task) < want / 6
