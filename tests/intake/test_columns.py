"""Hand-worked cells for cleaning, conversion and names."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewright.functions import clean, convert
from tidewright.operators import names, validate
from tidewright.plans.spec import FileTypeSpec, declared_type


def values(spark, cells, column, kind="string"):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], f"i int, c {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("c"))).collect()]


NUMBERS = ["12", '"1,234.5"', "1 000", "-", "-5", "", "   ", None, "12d", "NaN", "inf", "1e3", "99999999999", "abc", "12.5"]


def test_numbers(spark):
    assert values(spark, NUMBERS, clean.clean_numeric)[:6] == ["12", "1234.5", "1000", None, "-5", ""]
    assert values(spark, NUMBERS, convert.to_int) == [12, None, 1000, None, -5, None, None, None, None, None, None, None, None, None, None]
    assert values(spark, NUMBERS, convert.to_float) == [12.0, 1234.5, 1000.0, None, -5.0, None, None, None, None, None, None, 1000.0, 99999999999.0, None, 12.5]
    assert values(spark, ["a1.5b", "-", "", "x", None, "1-2"], clean.strip_to_number) == [1.5, None, None, None, None, None]
    df = spark.createDataFrame([(c,) for c in NUMBERS], "c string")
    got = validate.issues(df, [validate.numeric("c")]).first()
    assert (got.error_count, got.total, got.percentage, got.severity) == (4, 15, 26.67, "issue")


DAY = dt.datetime(2023, 12, 31)


@pytest.mark.parametrize(
    "cell,uk,us",
    [
        ("31/12/2023", DAY, DAY), ("01/02/2023", dt.datetime(2023, 2, 1), dt.datetime(2023, 1, 2)), ("12/31/2023", DAY, DAY), ("31.12.2023", DAY, None), ("31-12-23", DAY, None),
        ("31/12/85", dt.datetime(1985, 12, 31), None), ("2023-12-31 10:11:12", dt.datetime(2023, 12, 31, 10, 11, 12), dt.datetime(2023, 12, 31, 10, 11, 12)), ("31/02/2023", None, None),
        (" 31/12/2023\t", DAY, DAY), ("​31/12/2023", DAY, DAY), ("-", None, None), ("  ", None, None), (None, None, None), ("5/6/2023 7:08", dt.datetime(2023, 6, 5, 7, 8), dt.datetime(2023, 5, 6, 7, 8)),
    ],
)
def test_dates(spark, cell, uk, us):
    assert values(spark, [cell], convert.to_datetime) == [uk]
    assert values(spark, [cell], lambda c: convert.to_datetime(c, "US")) == [us]


def test_strict_ladder_is_narrower(spark):
    assert values(spark, ["31.12.2023", "31/12/2023"], lambda c: convert.to_date(c, strict=True)) == [None, DAY.date()]


def test_lenient_dates(spark):
    df = spark.createDataFrame([(1, "3 March 2021"), (2, "04/05/2021"), (3, "nonsense"), (4, None), (5, " ")], "i int, c string")
    got = {r.i: r.d for r in convert.parse_dates_leniently(df, "c", "d").collect()}
    assert got == {1: dt.datetime(2021, 3, 3), 2: dt.datetime(2021, 5, 4), 3: None, 4: None, 5: None}


def test_booleans(spark):
    assert values(spark, ["yes", " N ", "", None, "maybe", "TRUE", "0"], clean.standardize_boolean) == ["1", "0", "0", "0", "maybe", "1", "0"]


def test_names(spark):
    cells = ["  Order   ID #1 ", "​Date", "ราคา (บาท)", "ชื่อ สินค้า", None]
    normal, standard = ["order id #1", "date", "ราคา (บาท)", "ชื่อ สินค้า", ""], ["order_id_1", "date", "ราคา_บาท", "ช_อ_ส_นค_า", ""]
    assert values(spark, cells, names.normalize_name) == normal == [names.normalized(c) for c in cells]
    assert values(spark, cells, lambda c: names.standardize_name(F.translate(c, "​", ""))) == standard
    assert [names.standardized((c or "").replace("​", "")) for c in cells] == standard


def test_cleaner_by_kind():
    assert clean.cleaner("numeric") is clean.clean_numeric
    with pytest.raises(ValueError):
        clean.cleaner("other")


def test_thresholds(spark):
    df = spark.createDataFrame([(n,) for n in (10, 20, 25, 40, 50, 100)], "n int")
    assert [r[0] for r in df.select(names.threshold(F.col("n"))).collect()] == [0.3, 0.25, 0.2, 0.2, 0.1, 0.1]


def test_rename_directions(spark):
    spec = FileTypeSpec("sales", {"Date": "sale_date", "Amount": "amount"})
    assert names.rename_plan(["date ", "AMOUNT", "x"], spec) == {"date ": "sale_date", "AMOUNT": "amount"}
    assert names.rename_plan(["sale_date", "amount"], spec) == {"sale_date": "Date", "amount": "Amount"} or names.rename_plan(["sale_date", "amount"], spec)["sale_date"] == "Date"
    same = FileTypeSpec("same", {"Id": "Id", "Name": "Name"})
    assert names.rename_plan([" id", "Name"], same) == {" id": "Id"}
    df = names.rename_by_mapping(spark.createDataFrame([(1, 2)], "Date int, Amount int"), spec)
    assert df.columns == ["sale_date", "amount"]


def test_declared_types():
    assert [declared_type(t) for t in ("int", "NVARCHAR(50)", None, "GEOGRAPHY", "Datetime")] == ["INT", "NVARCHAR(MAX)", "NVARCHAR(MAX)", "NVARCHAR(MAX)", "DATETIME"]


def test_pattern_classes():
    import re

    assert re.match(validate.pattern_to_regex("[A-C]_%"), "Bx..") and not re.match(validate.pattern_to_regex("[A-C]_%"), "Dx") and re.match(validate.pattern_to_regex("a.b"), "a.b") and not re.match(validate.pattern_to_regex("a.b"), "axb")
