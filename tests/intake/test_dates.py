"""Free-form dates against a general parser, the order of day and month, row numbers by scan."""

import datetime as dt

import pytest
from dateutil import parser
from pyspark.sql import functions as F

from tidewright.functions.dates import date_order, lenient_datetime
from tidewright.operators import validate

MOMENTS = [dt.datetime(1995, 3, 7), dt.datetime(2024, 2, 29, 13, 5), dt.datetime(2001, 12, 31, 0, 0, 59), dt.datetime(1969, 5, 20, 12, 30)]
FORMATS = [
    "%d %B %Y", "%B %d, %Y", "%b %d %Y", "%d-%b-%Y", "%d%b%Y", "%Y %b %d", "%Y-%m-%d", "%Y/%m/%d", "%Y.%m.%d", "%Y%m%d", "%a, %d %b %Y", "%A %d %B %Y", "%d/%m/%Y", "%d.%m.%Y %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%d %B %Y %I:%M %p",
    "%b. %d, %Y %I:%M:%S%p", "%Y-%m-%d %H:%M:%S.250", "  %d   %b  %Y ",
]
NOT_DATES = ["", " ", "abc", "31/02/2023", "99 June 1995", "12 Juny 1995", "2024-13-45", "30 Feb 2020", "1995", "5 June 1995 25:00", "5 June 1995 13:00 pm", "1/2/3/4", None]


@pytest.mark.parametrize("day_first", [True, False])
def test_shapes_are_read_as_a_general_parser_reads_them(spark, day_first):
    swap = lambda f: f if day_first else f.replace("%d/%m/%Y", "%m/%d/%Y").replace("%d.%m.%Y", "%m.%d.%Y")
    texts = [m.strftime(swap(f)) for m in MOMENTS for f in FORMATS] + ["13/01/2020", "01/13/2020", "1st January 2020", "22nd Feb, 2021", "3-4-05", "4 sept 1999", "2024-01-02T03:04:05Z", "2024-01-02 03:04:05+07:00"]
    got = {r.t: r.v for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", lenient_datetime(F.col("t"), day_first).alias("v")).collect()}
    for t in texts:
        # a year in front is followed by the month, whatever the order (as in the ladder)
        assert got[t] == parser.parse(t, dayfirst=day_first and not t[:4].isdigit()).replace(tzinfo=None), t


def test_what_is_no_date_is_null(spark):
    rows = spark.createDataFrame([(t,) for t in NOT_DATES], "t string").select(lenient_datetime(F.col("t")).alias("v"))
    assert rows.where("v is not null").count() == 0


def test_order_by_evidence(spark):
    rows = spark.createDataFrame([("13/1/2020", "1/13/2020", "1/2/2020"), ("14-2-20", "2.14.20 10:00", "3/4/2020"), ("1/31/2020", "x", None), ("99/1/2020", "40/50/2020", "12/12/2020")], "d string, m string, n string")
    got = {r.column: tuple(r)[1:] for r in date_order(rows, ["d", "m", "n"], "US").collect()}
    assert got == {"d": (2, 1, "UK"), "m": (0, 2, "US"), "n": (0, 0, "US")}
    assert date_order(rows.where("false"), ["d"]).first().date_format_used == "UK"


def test_rows_are_numbered_while_files_are_scanned(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    for name, n in (("b.csv", 4000), ("a.csv", 3000)):
        (d / name).write_text("".join(f"{name},{i}\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        scan = spark.read.schema("f string, i int").csv(f"file://{d}")
        one = validate.numbered_by_scan(scan)
        plan = one._jdf.queryExecution().executedPlan().toString()
        own = one.select("f", "i", "_row_num").collect()
        all_ = validate.numbered_by_scan(scan, in_file=False).select("f", "i", "_row_num").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert "rangepartitioning" not in plan and plan.count("Exchange hashpartitioning") <= 1  # of one row a range
    assert len(own) == 7000 and all(r._row_num == r.i + 1 for r in own)
    assert all(r._row_num == r.i + 1 + (3000 if r.f == "b.csv" else 0) for r in all_)
