"""Merged profiles of loads against one over all rows."""

from pyspark.sql import functions as F

from tidewright.operators.profile import DISTINCT_ERROR, RANK_ERROR, ProfileStore, column_states, shown


def test_merged_states_are_those_of_all_rows(spark, tmp_path):
    rows = spark.range(30_000).select(F.col("id"), (F.col("id") % 700).cast("string").alias("s"), F.when(F.col("id") % 4 > 0, F.col("id") * F.col("id") / 7).alias("x"), F.lit(None).cast("int").alias("none"), F.lit(None).cast("string").alias("nothing"))
    store = ProfileStore(spark, f"file://{tmp_path}/p")
    assert store.profile().count() == 0
    for k in range(4):
        store.add(str(k), rows.where(F.col("id") % 4 == k))
    store.add("2", rows.where(F.col("id") % 4 == 2))  # sent again
    store.add("empty", rows.where("false"))
    got = {r.column: r for r in store.profile().collect()}
    one = {r.column: r for r in shown(column_states(rows)).collect()}
    for c in rows.columns:
        assert [got[c][k] for k in ("rows", "non_null", "distinct_values", "low_cardinality", "least", "most")] == [one[c][k] for k in ("rows", "non_null", "distinct_values", "low_cardinality", "least", "most")]
    assert abs(got["id"].distinct_values - 30_000) < DISTINCT_ERROR * 30_000 and abs(got["s"].distinct_values - 700) < DISTINCT_ERROR * 700 and got["s"].low_cardinality and got["s"].repeated_share > 0.9
    assert got["none"].distinct_values == 0 and got["none"].quantiles is None and got["nothing"].least is None
    for q, v in zip((0.25, 0.5, 0.75), got["x"].quantiles, strict=True):
        below = rows.where(F.col("x") <= v).count() / 22_500
        assert abs(below - q) < RANK_ERROR
