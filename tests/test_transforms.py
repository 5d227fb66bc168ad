import datetime as dt
import decimal

import pytest
from pyspark.sql import types as T

from sluice import operators as ops


def test_fill_nulls_types_are_checked(spark):
    df = spark.createDataFrame([(None, None, None)], "a bigint, s string, d date")
    out = ops.fill_nulls(df, {"a": -1, "s": "n/a", "d": dt.date(2024, 1, 1)}).first()
    assert out == (-1, "n/a", dt.date(2024, 1, 1))
    with pytest.raises(TypeError):
        ops.fill_nulls(df, {"a": "x"})
    with pytest.raises(TypeError):
        ops.fill_nulls(df, {"a": 1.5})
    with pytest.raises(ValueError):
        ops.fill_nulls(df, {"zz": 1})
    assert ops.fill_nulls(df, {}) is df


def test_cast_types_and_failures(spark):
    df = spark.createDataFrame([("1", 1.234), ("x", 2.0), (None, None)], "s string, p double")
    out = ops.cast_types(df, {"s": "int", "p": "decimal(5,2)"}).collect()
    assert [r["s"] for r in out] == [1, None, None]
    assert out[0]["p"] == decimal.Decimal("1.23")
    fails = {r["column_name"]: r for r in ops.cast_failures(df, {"s": "int", "p": "decimal(5,2)"}).collect()}
    assert fails["s"]["failed_count"] == 1 and fails["s"]["target_type"] == "int"
    assert fails["p"]["failed_count"] == 0


def test_strict_cast_raises(spark):
    df = spark.createDataFrame([("x",)], "s string")
    with pytest.raises(Exception):
        ops.cast_types(df, {"s": "int"}, strict=True).collect()


def test_migrate_schema(spark):
    df = spark.createDataFrame([(1, "7", "gone")], "id int, cust string, old string")
    target = T.StructType([T.StructField("key", T.LongType()), T.StructField("cust", T.IntegerType()), T.StructField("note", T.StringType()), T.StructField("extra", T.DoubleType())])
    out = ops.migrate_schema(df, target, renames={"id": "key"}, defaults={"note": "x"})
    assert out.schema == target or [f.dataType for f in out.schema.fields] == [f.dataType for f in target.fields]
    assert tuple(out.first()) == (1, 7, "x", None)


def test_steps_apply_in_order_and_unknown_names_raise(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "b")], "k int, s string")
    out = ops.apply_steps(df, [{"op": "deduplicate", "keys": ["k"]}, {"op": "fill_nulls", "values": {"s": "-"}}, "add_audit_columns"])
    assert sorted((r["k"], r["s"]) for r in out.collect()) == [(1, "-"), (2, "b")]
    assert {"_ingestion_ts", "_source"} <= set(out.columns)
    with pytest.raises(ValueError):
        ops.apply_steps(df, ["drop_nulls"])  # the original tool would have deduplicated here
    with pytest.raises(ValueError):
        ops.apply_steps(df, [{"keys": ["k"]}])


def test_aggregate_by_keys(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "g string, x double")
    out = {r["g"]: r for r in ops.aggregate_by_keys(df, "g").collect()}
    assert out["a"]["row_count"] == 2 and out["a"]["sum_x"] == 4.0 and out["a"]["avg_x"] == 2.0
    with pytest.raises(ValueError):
        ops.aggregate_by_keys(df, "g", stats=("median_x",))


def test_repartition_keeps_the_multiset(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 AS k")
    for out in (ops.repartition_rows(df, 5, "k"), ops.repartition_rows(df, 3, "k", by_range=True), ops.repartition_rows(df, 4)):
        assert sorted(r[0] for r in out.select("id").collect()) == list(range(1000))
    skew = ops.partition_skew(ops.repartition_rows(df, 5))
    assert sum(r["rows"] for r in skew.collect()) == 1000


def test_partitions_for_bytes(spark):
    from pyspark.sql import functions as F

    gib = 1024**3
    df = spark.createDataFrame([(1,), (20 * gib,), (200 * gib,), (100_000 * gib,)], "b bigint")
    got = [r[0] for r in df.select(ops.partitions_for_bytes(F.col("b"))).collect()]
    assert got == [50, 200, 800, 400_000]


def test_guarded_try_cast_equals_plain_try_cast(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from pyspark.sql import functions as F

    from sluice.functions import try_cast_col

    pieces = st.sampled_from(["1", "2", "9", "0", "-", "+", ".", "e", "E", " ", "\t", "x", "１", "٣", ",", "NaN", "Inf", "9999999999", "1e400"])
    texts = st.one_of(st.none(), st.lists(pieces, max_size=6).map("".join), st.text(max_size=6))

    @settings(max_examples=15, deadline=None, database=None)
    @given(st.lists(texts, min_size=1, max_size=40))
    def check(values):
        df = spark.createDataFrame([(v,) for v in values], "s string")
        for t in ("int", "bigint", "tinyint", "decimal(10,2)", "decimal(38,0)", "double"):
            plain = [r[0] for r in df.select(F.col("s").try_cast(t)).collect()]
            guarded = [r[0] for r in df.select(try_cast_col(df, "s", t)).collect()]
            assert [repr(x) for x in plain] == [repr(x) for x in guarded], t

    check()


def test_fill_ntz_timestamp_is_zone_free(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        df = spark.createDataFrame([(None,)], "ts timestamp_ntz")
        out = ops.fill_nulls(df, {"ts": dt.datetime(2024, 1, 2, 3, 4, 5, 6)}).first()["ts"]
        assert out == dt.datetime(2024, 1, 2, 3, 4, 5, 6)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_partition_summary_reports_skew(spark):
    from pyspark.sql import functions as F

    df = spark.range(1000).select(F.when(F.col("id") < 700, 0).otherwise(F.col("id")).alias("k"))
    s = ops.partition_summary(ops.repartition_rows(df, 4, "k")).first()
    assert s["partitions"] <= 4 and s["max_rows"] >= 700
    assert s["skew_ratio"] == s["max_rows"] / s["mean_rows"] and s["skew_ratio"] > 1.5
