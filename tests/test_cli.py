import datetime as dt

from sluice.__main__ import main
from sluice.sinks import write_table


def sales(spark, scratch):
    rows = [(i, dt.datetime(2024, 1, (i % 28) + 1, 10), f"user_{i % 20 + 1}", float(i * 10), dt.date(2024, 1, (i % 28) + 1)) for i in range(1, 101)]
    rows += [(i, dt.datetime(2024, 1, (i % 28) + 1, 10), f"user_{i}", float(i * 10), dt.date(2024, 1, (i % 28) + 1)) for i in range(1, 6)]
    path = scratch("cli_src")
    write_table(spark.createDataFrame(rows, "id int, event_ts timestamp, user_id string, amount double, date date"), path, format="csv", options={"header": "true"})
    return path


def test_cli_run_dq_and_stream(spark, scratch):
    src = sales(spark, scratch)
    target = scratch("cli_out")
    out = main(["run", "--source", src, "--target", target, "--partition-cols", "date", "--dedup-keys", "id", "--order-by", "user_id",
                "--cast", '{"amount": "decimal(12,2)"}'], spark=spark)
    assert out["rows_in"] == 105 and out["rows_written"] == 100 and out["dq_passed"]
    written = spark.read.parquet(target)
    assert {"_ingestion_ts", "_source"} <= set(written.columns)
    assert sorted(r["user_id"] for r in written.filter("id <= 5").collect()) == [f"user_{i}" for i in range(1, 6)]

    rep = main(["dq", "--source", target, "--report", scratch("cli_report"), "--null-threshold", "0.005", "--dupe-keys", "id"], spark=spark)
    assert {r["check"] for r in rep["report"]} >= {"null_rate", "duplicates", "dq_score"}

    events = scratch("cli_events")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(events)
    st = main(["stream", "--source", events, "--target", scratch("cli_stream"), "--checkpoint", scratch("cli_ckpt"), "--ts-column", "ts", "--grain", "day"], spark=spark)
    assert st["input_rows"] == spark.read.parquet(events).count()


def test_cli_dq_preset_and_kafka_arguments(spark, scratch):
    import pytest

    src = scratch("cli_dq_src")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(src)
    rep = main(["dq", "--source", src, "--report", scratch("cli_dq_rep"), "--dupe-keys", "event_id",
                "--freshness-column", "ts", "--as-of", "2024-01-31 00:00:00"], spark=spark)
    checks = {r["check"]: r for r in rep["report"]}
    assert checks["freshness"]["threshold"] == 2.0 and checks["null_rate"]["threshold"] == 0.005
    with pytest.raises(SystemExit):
        main(["stream", "--kafka-servers", "localhost:1", "--target", "t", "--checkpoint", "c", "--ts-column", "ts"], spark=spark)
    with pytest.raises(Exception) as e:  # connector absent here: a clear error, not a hang
        main(["stream", "--kafka-servers", "localhost:1", "--topic", "events", "--value-schema", "ts timestamp",
              "--target", scratch("k"), "--checkpoint", scratch("kc"), "--ts-column", "ts"], spark=spark)
    assert "kafka" in str(e.value).lower()


def test_migrate_and_aggregate(spark, scratch, capsys):
    source, new, sums = scratch("cli_source"), scratch("cli_new"), scratch("cli_sums")
    spark.createDataFrame([(1, "a", "2"), (2, "b", "3"), (3, "a", None)], "id bigint, kind string, amount string").write.parquet(source)
    out = main(["migrate", "--source", source, "--target", new, "--target-schema", "key bigint not null, kind string, amount int, channel string", "--rename", "id=key", "--defaults", '{"channel": "web"}', "--drop", ""], spark)
    assert (out["rows_in"], out["rows_written"]) == (3, 3) and {r["column_name"]: r["change"] for r in out["changes"]} == {"key": "renamed", "kind": "kept", "amount": "cast", "channel": "added"}
    args = ["aggregate", "--source", new, "--target", sums, "--keys", "kind", "--measures", "amount", "--partition-cols", "kind", "--mode", "add", "--batch-id", "one"]
    assert main(args, spark)["added"] and not main(args, spark)["added"]
    assert {(r["kind"], r["row_count"], r["sum_amount"], r["avg_amount"]) for r in spark.read.parquet(sums).collect()} == {("a", 2, 2, 2.0), ("b", 1, 3, 3.0)}
    assert '"added": false' in capsys.readouterr().out
