import datetime as dt

import pytest

from sluice import quality as dq
from sluice.operators import dedupe

SALES_SCHEMA = "id int, event_ts timestamp, user_id string, event_type string, amount double, currency string, date date"


def sales_events(spark):
    """The original tool's 105-row sample: ids 1..100, then ids 1..5 again with other users."""
    rows = []
    for i in range(1, 101):
        d = dt.date(2024, 1, (i % 28) + 1)
        rows.append((i, dt.datetime(2024, 1, (i % 28) + 1, 10), f"user_{i % 20 + 1}", "purchase", float(i * 10), "USD", d))
    for i in range(1, 6):
        d = dt.date(2024, 1, (i % 28) + 1)
        rows.append((i, dt.datetime(2024, 1, (i % 28) + 1, 10), f"user_{i}", "purchase", float(i * 10), "USD", d))
    return spark.createDataFrame(rows, SALES_SCHEMA)


def as_dict(df, key="column_name"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_sales_sample_matches_the_original_numbers(spark):
    df = sales_events(spark)
    score = dq.dq_score(df, {"null_threshold": 0.01, "dupe_check": True}).first()
    assert score["total_rows"] == 105
    assert score["duplicate_count"] == 5
    assert score["dq_score"] == 100.0 and score["passed"] is True
    assert score["all_checks_passed"] is False  # duplicates do not change the score, but do fail all checks
    kept = dedupe(df, "id", order_by="user_id")
    assert kept.count() == 100
    assert sorted(r["user_id"] for r in kept.filter("id <= 5").collect()) == [f"user_{i}" for i in range(1, 6)]


def test_rate_equal_to_threshold_passes_and_strictly_greater_fails(spark):
    df = spark.createDataFrame([(None,)] + [(1,)] * 99, "x int")
    r = as_dict(dq.null_rates(df, threshold=0.01))["x"]
    assert r["null_rate"] == 0.01 and r["passed"] is True
    r = as_dict(dq.null_rates(df, threshold=0.009))["x"]
    assert r["passed"] is False


def test_empty_frame_rates_are_zero_and_pass(spark):
    df = spark.createDataFrame([], "x int, y string")
    rates = as_dict(dq.null_rates(df))
    assert rates["x"]["null_rate"] == 0.0 and rates["x"]["passed"] is True
    d = dq.duplicates(df, ["x"]).first()
    assert d["distinct_keys"] == 0 and d["duplicate_count"] == 0


def test_one_all_null_row(spark):
    df = spark.createDataFrame([(None, None)], "x int, y string")
    rates = as_dict(dq.null_rates(df))
    assert rates["x"]["null_rate"] == 1.0 and rates["y"]["passed"] is False


def test_null_keys_count_once_like_drop_duplicates(spark):
    df = spark.createDataFrame([(None, None), (None, None), (1, None), (1, 2)], "a int, b int")
    d = dq.duplicates(df, ["a", "b"]).first()
    assert d["distinct_keys"] == 3 == df.dropDuplicates(["a", "b"]).count()
    single = dq.duplicates(df, ["a"]).first()
    assert single["distinct_keys"] == 2 == df.dropDuplicates(["a"]).count()


def test_score_counts_null_failures_only(spark):
    df = spark.createDataFrame([(None, None, 1)] * 2 + [(1, 1, 1)] * 2, "a int, b int, c int")
    s = dq.dq_score(df, {"null_threshold": 0.1}).first()
    assert s["null_failures"] == 2 and s["dq_score"] == 90.0 and s["passed"] is False


def test_score_floor_is_zero(spark):
    cols = ", ".join(f"c{i} int" for i in range(25))
    df = spark.createDataFrame([tuple([None] * 25)], cols)
    assert dq.dq_score(df).first()["dq_score"] == 0.0


def test_rules_are_typed(spark):
    with pytest.raises(TypeError):
        dq.DQRules.from_dict({"null_threshold": "high"})
    with pytest.raises(ValueError):
        dq.DQRules.from_dict({"nul_threshold": 0.1})
    with pytest.raises(TypeError):
        dq.DQRules.from_dict(["null_threshold"])
    with pytest.raises(ValueError):
        dq.DQRules.from_dict({"freshness_hours": 2, "freshness_column": "ts"})  # no as_of


def test_freshness_and_empty_table(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 30, 23, 0),)], "ts timestamp_ntz")
    f = dq.freshness(df, "ts", "2024-01-31 00:00:00", 2).first()
    assert f["fresh"] is True and abs(f["lag_hours"] - 1.0) < 1e-9
    assert dq.freshness(df, "ts", "2024-02-01 00:00:00", 2).first()["fresh"] is False
    empty = spark.createDataFrame([], "ts timestamp_ntz")
    assert dq.freshness(empty, "ts", "2024-01-31 00:00:00", 2).first()["fresh"] is False


def test_report_is_one_job_with_every_check(spark):
    df = sales_events(spark)
    rules = {"null_threshold": 0.01, "dupe_check": True, "min_rows": 100, "expected_columns": ["id", "missing"]}
    rep = dq.dq_report(df, rules).collect()
    checks = [r["check"] for r in rep]
    assert checks.count("null_rate") == 7
    assert {"duplicates", "min_rows", "expected_columns", "dq_score", "all_checks"} <= set(checks)
    exp = [r for r in rep if r["check"] == "expected_columns"][0]
    assert exp["column_name"] == "missing" and exp["passed"] is False


def test_quarantine_partitions_the_input(spark):
    df = spark.createDataFrame([(1, 5.0), (None, 1.0), (3, None), (4, 500.0)], "u int, v double")
    rules = {**dq.not_null_rules(["u", "v"]), "v_small": "v < 100"}
    clean, bad = dq.quarantine(df, rules)
    assert clean.count() + bad.count() == df.count()
    errs = {r["u"]: r["_dq_errors"] for r in bad.collect()}
    assert errs[None] == ["u_not_null"]
    assert errs[3] == ["v_not_null", "v_small"]
    assert errs[4] == ["v_small"]
    summary = {r["rule"]: r["broken_rows"] for r in dq.quarantine_summary(df, rules).collect()}
    assert summary == {"u_not_null": 1, "v_not_null": 1, "v_small": 2}


def test_schema_drift(spark):
    from pyspark.sql import types as T

    df = spark.createDataFrame([(1, "x", None)], "a bigint, b string, c string")
    expected = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("d", T.StringType()), T.StructField("b", T.StringType())])
    out = as_dict(dq.schema_drift(df, expected))
    assert out["a"]["change"] == "type_changed"
    assert out["d"]["change"] == "removed"
    assert out["b"]["change"] == "unchanged"
    assert out["c"]["change"] == "added" and out["c"]["non_null_count"] == 0
    assert dq.has_drift(expected, df.schema)


def test_expectations(spark):
    df = sales_events(spark)
    out = {r["criterion"]: r for r in dq.expectations(df, {"min_rows": 200, "expected_columns": ["id"], "dupe_check": True}).collect()}
    assert out["min_rows"]["met"] is False and out["min_rows"]["observed"] == 105
    assert out["expected_columns"]["met"] is True
    assert out["duplicates:id"]["observed"] == 5
    assert out["all"]["met"] is False


def test_wide_table_report(spark):
    n = 300
    cols = ", ".join(f"c{i} int" for i in range(n))
    rows = [tuple(None if (i + j) % 97 == 0 else j for i in range(n)) for j in range(50)]
    df = spark.createDataFrame(rows, cols)
    rep = dq.dq_report(df, {"null_threshold": 0.01}).collect()
    rates = [r for r in rep if r["check"] == "null_rate"]
    assert len(rates) == n
    failing = sum(1 for r in rates if not r["passed"])
    score = [r for r in rep if r["check"] == "dq_score"][0]
    assert score["observed"] == max(0.0, 100.0 - 5 * failing)


def test_dotted_names_and_hours_that_a_zone_skips(spark):
    from sluice import operators as ops
    from sluice.functions import hour_bucket

    df = spark.createDataFrame([(1, "x"), (1, None)], "`a.b` int, `c.d` string")
    assert {r["column_name"]: r["null_count"] for r in dq.null_rates(df).collect()} == {"a.b": 0, "c.d": 1}
    assert dq.duplicates(df, ["a.b"]).first()["duplicate_count"] == 1
    assert ops.dedupe(df, ["a.b"]).count() == 1
    assert ops.fill_nulls(df, {"c.d": "-"}).where("`c.d` = '-'").count() == 1
    assert ops.aggregate_by_keys(df, "c.d", ["a.b"], stats=("sum",)).count() == 2
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        t = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-10 02:30:00' AS ts")
        assert t.select(hour_bucket("ts").alias("h")).first()["h"] == "2024-03-10-02"
        assert dq.freshness(t, "ts", "2024-03-10 04:30:00", 3).first()["lag_hours"] == 2.0
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_schema_drift_fails_all_checks_but_not_the_score(spark):
    df = spark.createDataFrame([(1, "x")], "k int, v string")
    row = dq.dq_score(df, {"expected_schema": "k bigint, v string"}).first()
    assert row["passed"] is True and row["all_checks_passed"] is False
    assert dq.dq_score(df, {"expected_schema": "k int, v string"}).first()["all_checks_passed"] is True
