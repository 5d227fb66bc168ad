"""F4 schema migration and F5 aggregation flows."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sluice.plans import (
    AggregationSpec,
    MigrationError,
    MigrationSpec,
    combine_aggregates,
    goals,
    migration_changes,
    run_aggregation,
    run_migration,
)
from sluice.sinks import write_table
from sluice.sources import read_table

SOURCE = "id bigint, name string, amount string, kind string, `a.b` int"
ROWS = [(1, "x", "1.50", "k", 1), (2, None, "n/a", "k", 2), (3, "z", None, None, None), (4, "z", "12345678901", "l", 4)]


@pytest.fixture()
def source(spark, scratch):
    path = scratch("goals_source")
    write_table(spark.createDataFrame(ROWS, SOURCE), path, mode="error")
    return path


def exists(spark, path):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def test_migration_changes_counts_losses_and_nulls(spark):
    df = spark.createDataFrame(ROWS, SOURCE)
    got = {r["column_name"] or r["source_name"]: tuple(r) for r in migration_changes(df, "key bigint, amount decimal(6,2), `a.b` string, note string", {"id": "key"}, {"note": "-"}).collect()}
    assert got["key"] == ("key", "id", "renamed", "bigint", "bigint", 0, 0)
    assert got["amount"] == ("amount", "amount", "cast", "string", "decimal(6,2)", 2, 3)
    assert got["a.b"] == ("a.b", "a.b", "cast", "int", "string", 0, 1)
    assert got["note"] == ("note", None, "added", None, "string", 0, 0)
    assert got["name"] == (None, "name", "dropped", "string", None, None, None) and got["kind"][2] == "dropped"
    empty = migration_changes(df.limit(0), "key bigint, amount decimal(6,2)", {"id": "key"}).collect()
    assert all(r["lost_values"] in (0, None) for r in empty)


def test_migration_writes_the_new_version(spark, source, scratch):
    target = scratch("goals_target")
    ddl = "key bigint not null, amount decimal(6,2), kind string"
    done = run_migration(spark, MigrationSpec(source_path=source, target_path=target, target_schema=ddl, renames={"id": "key"}, drops=("name", "a.b"), partition_cols=("kind",), on_loss="report"))
    assert (done.metrics.rows_in, done.metrics.rows_out) == (4, 4)
    rows = {tuple(r) for r in read_table(spark, target, schema=ddl).collect()}
    assert rows == {(1, Decimal("1.50"), "k"), (2, None, "k"), (3, None, None), (4, None, "l")}


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        ({"drops": ("name",)}, "would be dropped"),
        ({"on_loss": "block"}, "lose values"),
        ({"target_schema": "key bigint, name string not null, amount string, kind string, `a.b` int"}, "NOT NULL"),
        ({"target_schema": "key bigint, added string not null", "drops": None}, "NOT NULL"),
    ],
)
def test_migration_is_refused_before_anything_is_written(spark, source, scratch, change, reason):
    target = scratch("goals_refused")
    spec = {"target_schema": "key bigint, amount decimal(6,2)", "drops": ("name", "kind", "a.b"), "on_loss": "report", **change}
    with pytest.raises(MigrationError, match=reason) as error:
        run_migration(spark, MigrationSpec(source_path=source, target_path=target, renames={"id": "key"}, **spec))
    assert error.value.changes and not exists(spark, target)


def test_migration_arguments():
    with pytest.raises(ValueError, match="must not overwrite"):
        MigrationSpec(source_path="/t/", target_path="/t", target_schema="a int")
    with pytest.raises(ValueError, match="on_loss"):
        MigrationSpec(source_path="/s", target_path="/t", target_schema="a int", on_loss="ignore")


# ---------------------------------------------------------------- aggregation

EVENTS = "day string, kind string, v bigint, w double"
FIRST = [("01", "a", 1, 0.5), ("01", "a", None, None), ("01", None, 5, 1.0), (None, "a", 7, 2.0), ("02", "b", None, None), ("03", "c", 9, 9.0)]
SECOND = [("01", "a", 10, 4.0), (None, "a", -3, None), (None, "b", 2, 1.0), ("02", "b", 4, 1.5), ("04", "d", 1, 1.0)]


def plain(rows):
    """(day, kind) -> row_count, then count, sum, min, max, average of each measure."""
    groups = {}
    for day, kind, v, w in rows:
        groups.setdefault((day, kind), []).append((v, w))
    out = {}
    for key, own in groups.items():
        got = [len(own)]
        for k in (0, 1):
            x = [r[k] for r in own if r[k] is not None]
            got += [len(x), sum(x), min(x), max(x), sum(x) / len(x)] if x else [0, None, None, None, None]
        out[key] = tuple(got)
    return out


def table(spark, path):
    columns = ["row_count", *[f"{s}_{m}" for m in "vw" for s in ("count", "sum", "min", "max", "avg")]]
    schema = "kind string, row_count bigint, count_v bigint, sum_v bigint, min_v bigint, max_v bigint, count_w bigint, sum_w double, min_w double, max_w double, avg_v double, avg_w double, day string"
    rows = read_table(spark, path, schema=schema).collect()
    got = {(r["day"], r["kind"]): tuple(r[c] for c in columns) for r in rows}
    assert len(got) == len(rows)
    return got


def aggregate(spark, scratch, rows, target, **more):
    path = scratch("goals_batch")
    write_table(spark.createDataFrame(rows, EVENTS), path, mode="error")
    return run_aggregation(spark, AggregationSpec(source_path=path, target_path=target, keys=("day", "kind"), partition_cols=("day",), **more))


def test_aggregation_overwrite(spark, scratch):
    target = scratch("goals_agg")
    for rows in (FIRST, SECOND):
        assert aggregate(spark, scratch, rows, target).added
        assert table(spark, target) == plain(rows)


def test_aggregation_adds_each_batch_once(spark, scratch):
    target = scratch("goals_add")
    assert aggregate(spark, scratch, FIRST, target, mode="add", batch_id="1").added
    assert table(spark, target) == plain(FIRST)
    files = {f.name for f in _data_files(spark, target, "day=03")}
    assert aggregate(spark, scratch, SECOND, target, mode="add", batch_id="2").added
    assert table(spark, target) == plain(FIRST + SECOND)
    assert {f.name for f in _data_files(spark, target, "day=03")} == files  # untouched partitions are not rewritten
    again = aggregate(spark, scratch, SECOND, target, mode="add", batch_id="2")
    assert not again.added and again.write.rows_written == 0 and table(spark, target) == plain(FIRST + SECOND)
    aggregate(spark, scratch, [], target, mode="add", batch_id="nothing")
    assert table(spark, target) == plain(FIRST + SECOND)


def _data_files(spark, target, partition):
    from pathlib import Path

    return list(Path(f"{target}/{partition}".removeprefix("file:")).glob("part-*"))


@pytest.mark.parametrize("lost", ["publish", "note"])
def test_a_batch_that_failed_half_way_is_finished_first(spark, scratch, monkeypatch, lost):
    target = scratch("goals_failed")
    aggregate(spark, scratch, FIRST, target, mode="add", batch_id="1")
    if lost == "publish":  # prepared, not published
        monkeypatch.setattr(goals, "republish", _fail)
    else:  # published, not noted as done
        real = goals._note
        monkeypatch.setattr(goals, "_note", lambda spark_, path, *a: _fail() if "/done/" in path else real(spark_, path, *a))
    with pytest.raises(RuntimeError, match="lost"):
        aggregate(spark, scratch, SECOND, target, mode="add", batch_id="2")
    monkeypatch.undo()
    third = [("01", "a", 100, 1.0), ("05", "e", 1, 1.0)]
    assert aggregate(spark, scratch, third, target, mode="add", batch_id="3").added  # finishes batch 2, then adds its own
    assert table(spark, target) == plain(FIRST + SECOND + third)
    assert not aggregate(spark, scratch, SECOND, target, mode="add", batch_id="2").added
    assert table(spark, target) == plain(FIRST + SECOND + third)


def _fail(*args, **kwargs):
    raise RuntimeError("executor lost")


def test_combine_keeps_types(spark):
    from sluice.plans.goals import stored_aggregates, with_averages

    rows = [(dt.date(2024, 1, 1), Decimal("1.50")), (dt.date(2024, 1, 1), Decimal("2.50")), (None, None)]
    part = stored_aggregates(spark.createDataFrame(rows, "d date, p decimal(10,2)"), ["d"])
    whole = combine_aggregates([part, part, part], ["d"], ["p"])
    assert [f.dataType for f in whole.schema] == [f.dataType for f in part.schema]
    got = {r["d"]: (r["row_count"], r["sum_p"], r["avg_p"]) for r in with_averages(whole, ["p"]).collect()}
    assert got == {dt.date(2024, 1, 1): (6, Decimal("12.00"), 2.0), None: (3, None, None)}


def test_aggregation_arguments():
    base = {"source_path": "/s", "target_path": "/t", "keys": ("a",)}
    with pytest.raises(ValueError, match="among the keys"):
        AggregationSpec(**base, partition_cols=("b",))
    with pytest.raises(ValueError, match="batch_id"):
        AggregationSpec(**base, mode="add", partition_cols=("a",))
    with pytest.raises(ValueError, match="mode must be"):
        AggregationSpec(**base, mode="append")


def test_add_prunes_the_target_scan(spark, scratch):
    from sluice.sinks.merge import rows_in_partitions

    target = scratch("goals_pruned")
    write_table(spark.createDataFrame(FIRST, EVENTS), target, mode="error", partition_cols=["day"])
    df = read_table(spark, target, schema=EVENTS)
    touched = rows_in_partitions(df, spark.createDataFrame([("01",), (None,)], "day string"), ["day"])
    assert {r["day"] for r in touched.collect()} == {"01", None}
    text = touched._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in text and "PartitionFilters: []" not in text
    assert rows_in_partitions(df, df.select("day").where(F.lit(False)), ["day"]) is None
