import pytest
from pyspark.sql import functions as F

from sluice import operators as ops
from sluice.plans import DQGateError, PipelineSpec, lineage_edges, lineage_nodes, run_dq_suite, run_etl, run_with_metrics
from sluice.sinks import write_table
from sluice.sources import read_table


def staged(spark, scratch, n=300):
    src = scratch("src")
    df = spark.range(n).selectExpr("id", "id % 4 AS grp", "CASE WHEN id % 50 = 0 THEN NULL ELSE id * 1.5 END AS x", "id % 5 AS part")
    write_table(df.unionByName(df.filter("id < 30")), src, partition_cols=["grp"])
    return src


def test_edges_sum_to_output_rows(spark, scratch):
    src = read_table(spark, staged(spark, scratch), "parquet", with_source_file=True)
    out = scratch("out")
    write_table(ops.dedupe(src.drop("grp"), "id"), out, partition_cols=["part"])
    written = spark.read.parquet(out)
    edges = lineage_edges(written, level="directory")
    assert edges.agg(F.sum("rows")).first()[0] == written.count() == 300
    nodes = {(r["node"], r["kind"]): r["rows"] for r in lineage_nodes(edges).collect()}
    assert nodes[("grp=0", "source")] == 75 and nodes[("part=0", "sink")] == 60
    file_edges = lineage_edges(written, level="file")
    assert file_edges.agg(F.sum("rows")).first()[0] == 300


def test_run_metrics_are_observed_in_the_write_job(spark, scratch):
    src = read_table(spark, staged(spark, scratch), "parquet")
    m = run_with_metrics(src, lambda df: ops.dedupe(df, "id"), scratch("rm"))
    assert (m.rows_in, m.rows_out, m.rows_removed) == (330, 300, 30)


def test_etl_gate_blocks_the_write(spark, scratch):
    src = staged(spark, scratch)
    target = scratch("etl")
    spec = PipelineSpec(source_path=src, target_path=target, rules={"null_threshold": 0.01}, steps=({"op": "deduplicate", "keys": ["id"]},))
    with pytest.raises(DQGateError):
        run_etl(spark, spec)
    with pytest.raises(Exception):
        spark.read.parquet(target).count()  # nothing written
    ok = PipelineSpec(
        source_path=src,
        target_path=target,
        rules={"null_threshold": 0.01, "dupe_check": True, "dupe_keys": ["id"]},
        steps=({"op": "deduplicate", "keys": ["id"]}, {"op": "fill_nulls", "values": {"x": 0.0}}, "add_audit_columns"),
        partition_cols=("part",),
        lineage=True,
    )
    res = run_etl(spark, ok)
    assert res.passed and res.metrics.rows_in == 330 and res.write.rows_written == 300
    assert "_source_file" in spark.read.parquet(target).columns


def test_etl_report_mode_checks_the_rows_of_the_run(spark, scratch):
    src = staged(spark, scratch)
    spec = PipelineSpec(source_path=src, target_path=scratch("rep"), rules={"null_threshold": 0.01}, gate="report")
    res = run_etl(spark, spec)
    assert res.passed is False and res.write.rows_written == 330


def test_dq_suite_publishes_the_report(spark, scratch):
    df = spark.range(10).selectExpr("id", "CAST('2024-01-30 23:00:00' AS TIMESTAMP_NTZ) AS ts")
    rules = {"null_threshold": 0.005, "dupe_check": True, "freshness_hours": 2, "freshness_column": "ts", "as_of": "2024-01-31 00:00:00"}
    report, res = run_dq_suite(df, rules, report_path=scratch("suite"))
    assert res.rows_written == report.count() == 6  # 2 null rates, duplicates, freshness, score, all
    assert all(r["passed"] for r in report.collect())


def test_etl_staged_gate_runs_the_steps_once(spark, scratch):
    src = staged(spark, scratch)
    spec = PipelineSpec(
        source_path=src,
        target_path=scratch("staged"),
        rules={"null_threshold": 0.01, "dupe_check": True, "dupe_keys": ["id"]},
        steps=({"op": "deduplicate", "keys": ["id"]}, {"op": "fill_nulls", "values": {"x": 0.0}}),
        stage=True,
    )
    res = run_etl(spark, spec)
    assert res.passed and res.metrics.rows_in == 330 and res.metrics.rows_out == 300
    assert spark.read.parquet(spec.target_path).count() == 300
    bad = PipelineSpec(source_path=src, target_path=scratch("staged_bad"), rules={"null_threshold": 0.01}, stage=True)
    with pytest.raises(DQGateError):
        run_etl(spark, bad)


def test_metrics_when_the_steps_fold_to_nothing(spark, scratch):
    from sluice.sinks import write_table as _write

    m = run_with_metrics(spark.range(10).selectExpr("id AS a"), lambda df: df.filter("1 = 0"), scratch("fold"))
    assert (m.rows_in, m.rows_out) == (10, 0)
    assert _write(spark.createDataFrame([], "a int, p int"), scratch("empty"), partition_cols=["p"]).rows_written == 0


def test_etl_upsert_mode_merges_into_touched_partitions(spark, scratch):
    from sluice.sources import list_files

    first = scratch("up_src1")
    write_table(spark.range(40).selectExpr("id", "id % 4 AS part", "'v1' AS v"), first)
    target = scratch("up_target")
    spec = dict(target_path=target, partition_cols=("part",), write_mode="upsert", merge_keys=("id",), rules={"null_threshold": 0.0})
    res1 = run_etl(spark, PipelineSpec(source_path=first, **spec))
    assert res1.write.rows_written == 40
    before = {r["path"] for r in list_files(spark, target).collect()}
    second = scratch("up_src2")
    write_table(spark.createDataFrame([(1, 1, "v2"), (5, 1, "v2"), (100, 1, "new")], "id bigint, part bigint, v string"), second)
    res2 = run_etl(spark, PipelineSpec(source_path=second, **spec))
    assert res2.metrics.rows_in == 3 and res2.write.rows_written == 11  # partition part=1 only
    out = {r["id"]: r["v"] for r in spark.read.parquet(target).collect()}
    assert len(out) == 41 and out[1] == "v2" and out[5] == "v2" and out[100] == "new" and out[2] == "v1"
    after = {r["path"] for r in list_files(spark, target).collect()}
    assert {p for p in before if "part=1" not in p} <= after  # other partitions untouched
    with pytest.raises(ValueError):
        PipelineSpec(source_path=second, target_path=target, write_mode="merge")


def test_etl_quarantines_broken_rows_and_publishes_the_rest(spark, scratch):
    src = staged(spark, scratch)  # 330 rows, x NULL where id % 50 = 0
    spec = PipelineSpec(
        source_path=src,
        target_path=scratch("q_target"),
        steps=({"op": "deduplicate", "keys": ["id"]},),
        rules={"null_threshold": 0.0, "dupe_check": True, "dupe_keys": ["id"]},
        quarantine_rules={"x_present": "x IS NOT NULL", "x_small": "x < 400"},
        quarantine_path=scratch("q_bad"),
        partition_cols=("part",),
    )
    res = run_etl(spark, spec)
    clean = spark.read.parquet(spec.target_path)
    bad = spark.read.parquet(spec.quarantine_path)
    assert res.passed and res.metrics.rows_in == 330
    assert clean.count() + bad.count() == 300
    assert clean.filter("x IS NULL OR x >= 400").count() == 0
    errs = {r["id"]: r["_dq_errors"] for r in bad.collect()}
    assert errs[0] == ["x_present", "x_small"] and errs[299] == ["x_small"]
    assert res.quarantined.rows_written == bad.count()


def test_exact_counts_option(spark, scratch):
    src = staged(spark, scratch)
    for stage in (False, True):
        spec = PipelineSpec(source_path=src, target_path=scratch("exact"), steps=({"op": "deduplicate", "keys": ["id"]},),
                            rules={"null_threshold": 0.05}, stage=stage, exact_counts=True)
        res = run_etl(spark, spec)
        assert (res.metrics.rows_in, res.metrics.rows_out) == (330, 300)
    m = run_with_metrics(read_table(spark, src, "parquet"), lambda df: ops.dedupe(df, "id"), scratch("rm_exact"), exact_source_count=True)
    assert (m.rows_in, m.rows_out) == (330, 300)


def test_report_mode_judges_only_this_run(spark, scratch):
    target = scratch("rep_two")
    for rows, ok in ((["NULL"], False), (["1"], True)):
        src = scratch("rep_src")
        spark.sql(f"SELECT 1 AS k, CAST({rows[0]} AS INT) AS x").write.parquet(src)
        res = run_etl(spark, PipelineSpec(source_path=src, target_path=target, rules={"null_threshold": 0.01}, gate="report"))
        assert res.passed is ok
    assert spark.read.parquet(target).count() == 2


def test_empty_source_runs_through_the_quarantine_flow(spark, scratch):
    src = scratch("empty_src")
    spark.range(0).selectExpr("id AS k", "CAST(id AS STRING) AS x").write.parquet(src)
    spec = PipelineSpec(source_path=src, target_path=scratch("empty_out"), quarantine_rules={"x": "x IS NOT NULL"}, quarantine_path=scratch("empty_bad"))
    res = run_etl(spark, spec)
    assert (res.metrics.rows_in, res.metrics.rows_out, res.quarantined.rows_written) == (0, 0, 0)


def test_upsert_metrics_count_the_batch(spark, scratch):
    target = scratch("up")
    spec = lambda src: PipelineSpec(source_path=src, target_path=target, write_mode="upsert", merge_keys=("k",), partition_cols=("p",))
    first, second = scratch("up1"), scratch("up2")
    spark.sql("SELECT id AS k, id AS v, id % 2 AS p FROM range(4) UNION ALL SELECT 1, 9, 1").write.parquet(first)
    res = run_etl(spark, spec(first))
    assert (res.metrics.rows_in, res.metrics.rows_out, res.metrics.rows_removed) == (5, 4, 1)
    spark.sql("SELECT 0L AS k, 5L AS v, 0L AS p").write.parquet(second)
    res = run_etl(spark, spec(second))
    assert (res.metrics.rows_in, res.metrics.rows_out, res.write.rows_updated, res.write.rows_inserted, res.write.rows_written) == (1, 1, 1, 0, 2)
