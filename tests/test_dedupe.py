import pytest
from pyspark.sql import functions as F

from sluice.operators import dedupe


def rows(df, *cols):
    picked = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)


def test_default_key_is_first_column_and_survivor_is_smallest_rest(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 9), (2, "z", 1)], "id int, s string, n int")
    out = dedupe(df)
    assert out.columns == ["id", "s", "n"]
    assert rows(out) == [(1, "a", 9), (2, "z", 1)]


def test_null_keys_form_one_group(spark):
    df = spark.createDataFrame([(None, None, 1), (None, None, 2), (1, None, 3), (1, 2, 4)], "a int, b int, v int")
    out = dedupe(df, ["a", "b"])
    assert out.count() == 3
    assert rows(out) == sorted([(None, None, 1), (1, None, 3), (1, 2, 4)], key=repr)


def test_null_order_values_sort_first(spark):
    df = spark.createDataFrame([(1, 5), (1, None)], "k int, v int")
    assert rows(dedupe(df, "k")) == [(1, None)]
    assert rows(dedupe(df, "k", keep="last")) == [(1, 5)]


def test_order_by_then_rest_breaks_ties(spark):
    df = spark.createDataFrame([(1, 1, "x"), (1, 2, "b"), (1, 2, "a")], "k int, ver int, s string")
    assert rows(dedupe(df, "k", order_by="ver", keep="last")) == [(1, 2, "b")]
    assert rows(dedupe(df, "k", order_by="ver", keep="first")) == [(1, 1, "x")]


def test_keep_any_is_drop_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, s string")
    assert dedupe(df, "k", keep="any").count() == 2


def test_keys_only_frame(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert rows(dedupe(df, "k")) == [(1,), (2,)]


def test_map_columns_are_rejected(spark):
    df = spark.createDataFrame([(1, {"a": 1})], "k int, m map<string,int>")
    with pytest.raises(TypeError):
        dedupe(df, "k")
    with pytest.raises(TypeError):
        dedupe(df, "m")


def test_unknown_key_raises_before_any_job(spark):
    df = spark.createDataFrame([(1,)], "k int")
    with pytest.raises(ValueError):
        dedupe(df, "nope")


def test_empty_frame(spark):
    df = spark.createDataFrame([], "k int, v string")
    assert dedupe(df, "k").count() == 0


def test_hot_key_is_combined_before_the_shuffle(spark):
    """A key with most of the rows: the partial aggregate runs before the exchange."""
    df = spark.range(0, 20000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    out = dedupe(df, "k")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan
    assert out.count() == 1 + 20000 - 6667
    assert out.filter("k = 0").first()["v"] == 0
