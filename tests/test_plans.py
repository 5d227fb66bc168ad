"""Plan-shape checks: the properties that matter at scale, asserted on the physical plan."""

from pyspark.sql import functions as F

from sluice import operators as ops
from sluice import quality as dq
from sluice.sinks import merge_upsert

from paths import SF01


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan_through_a_chain(spark):
    orders = spark.read.parquet(f"{SF01}/orders.parquet")
    chained = ops.apply_steps(orders, [{"op": "fill_nulls", "values": {"o_totalprice": 0.0}}, "add_audit_columns"])
    q = chained.filter(F.col("o_orderstatus") == "F").select("o_orderkey", "o_totalprice")
    p = plan(q)
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in p


def test_dq_report_is_a_single_aggregate_without_joins(spark):
    ev = spark.read.parquet(f"{SF01}/events.parquet")
    p = plan(dq.dq_report(ev, {"dupe_check": True, "dupe_keys": ["user_id"]}))
    assert "Join" not in p
    # null counts: one global aggregate; duplicates: a branch that reads only the key column
    assert "ReadSchema: struct<user_id:bigint>" in p
    key_shuffle = [line for line in p.splitlines() if "hashpartitioning" in line]
    assert len(key_shuffle) == 1 and "_n0" not in key_shuffle[0]


def test_null_rates_without_distinct_do_not_shuffle_rows(spark):
    ev = spark.read.parquet(f"{SF01}/events.parquet")
    p = plan(dq.null_rates(ev))
    assert "hashpartitioning" not in p  # partial counts per task, one tiny final merge


def test_merge_broadcasts_by_size_only(spark):
    """Updates above the broadcast threshold are joined by a sort-merge anti join."""
    o = spark.read.parquet(f"{SF01}/orders.parquet")
    m = merge_upsert(o, o.filter("o_orderdate >= '2000-01-01'"), "o_orderkey")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    try:
        p = m.select("*")._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" in p and "LeftAnti" in p and "Broadcast" not in p


def test_write_rebalances_on_partition_columns(spark):
    from sluice.sinks import prepare_write

    ev = spark.read.parquet(f"{SF01}/events.parquet")
    p = plan(prepare_write(ev, ["event_type"]))
    assert "REBALANCE_PARTITIONS_BY_COL" in p
    assert "Exchange" not in plan(prepare_write(ev, []))  # no partition columns: no extra shuffle


def test_dedupe_combines_before_the_shuffle(spark):
    li = spark.read.parquet(f"{SF01}/lineitem.parquet")
    p = plan(ops.dedupe(li, ["l_orderkey", "l_linenumber"]))
    assert p.index("Exchange") < p.index("partial_min")  # printed top-down: partial sits below the exchange
    assert "Window" not in p


def test_merge_update_keys_are_pruned_to_a_distinct(spark):
    o = spark.read.parquet(f"{SF01}/orders.parquet")
    m = merge_upsert(o.filter("o_orderdate < '1999-01-01'"), o.filter("o_orderdate >= '1998-01-01'"), "o_orderkey")
    p = plan(m)
    assert "LeftAnti" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in p  # key side reads two columns


def test_merge_into_a_bucketed_target_does_not_shuffle_the_target(spark):
    from sluice.sinks import write_bucketed_table

    name = "sluice_bucketed_orders"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    orders = spark.read.parquet(f"{SF01}/orders.parquet")
    saved = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        res = write_bucketed_table(orders, name, "o_orderkey", 8)
        assert res.rows_written == orders.count()
        # the sort-merge plan, as it is when the update side is too big to broadcast
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        m = merge_upsert(spark.table(name), orders.filter("o_orderdate >= '2000-01-01'"), "o_orderkey")
        lines = plan(m).splitlines()
        smj = next(i for i, line in enumerate(lines) if "SortMergeJoin" in line)
        target = next(i for i, line in enumerate(lines) if "Bucketed: true" in line)
        assert smj < target
        assert not any("Exchange" in line for line in lines[smj:target])  # target side: no shuffle
        assert m.count() == orders.count()
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
