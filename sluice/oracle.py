"""DuckDB SQL equal in meaning to each registered query (see ``sluice.queries``).

Column names and types are aliased / cast to match the Spark results exactly. 
"""

from __future__ import annotations

from sluice.operators.layout import LARGEST_TIER_PARTITIONS, SIZE_TIERS, TARGET_PARTITION_BYTES
from sluice.queries import AS_OF, AS_OF_STALE, EVENT_COLS, LINEITEM_COLS, LINEITEM_KEYS, ORDER_COLS

EVENTS_NULLS = """events_nulls AS (
  SELECT event_id, ts,
         CASE WHEN event_id % 500 = 0 THEN NULL ELSE user_id END AS user_id,
         event_type,
         CASE WHEN event_id % 50 = 0 THEN NULL ELSE value END AS value,
         props
  FROM events)"""

HOUR_US = "CAST(3600000000 AS DOUBLE)"


def _dedupe_sql(table: str, cols: list[str], keys: list[str]) -> str:
    rest = [c for c in cols if c not in keys]
    order = ", ".join(f"{c} ASC NULLS FIRST" for c in rest)
    return (
        f"SELECT {', '.join(cols)} FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY {', '.join(keys)} ORDER BY {order}) AS _rn FROM {table}) WHERE _rn = 1"
    )


def _null_aggs(cols: list[str]) -> str:
    return ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS _n{i}" for i, c in enumerate(cols))


def _rate(i: int) -> str:
    return f"(_n{i} / greatest(_rows, 1))"


def _fails(cols: list[str], thr: float) -> str:
    return "(" + " + ".join(f"CASE WHEN {_rate(i)} > {thr} THEN 1 ELSE 0 END" for i in range(len(cols))) + ")"


def _one_pass(source: str, cols: list[str], dupe_key: str | None = None, fresh_col: str | None = None) -> str:
    parts = ["count(*) AS _rows", _null_aggs(cols)]
    if dupe_key:
        parts.append(f"count(DISTINCT {dupe_key}) + max(CASE WHEN {dupe_key} IS NULL THEN 1 ELSE 0 END) AS _distinct")
    if fresh_col:
        parts.append(f"max({fresh_col}) AS _max_ts")
    return f"SELECT {', '.join(parts)} FROM {source}"


def _lag(as_of: str) -> str:
    return f"((epoch_us(TIMESTAMP '{as_of}') - epoch_us(_max_ts)) / {HOUR_US})"


def _fresh(as_of: str, hours: float) -> str:
    return f"coalesce({_lag(as_of)} <= {float(hours)}, false)"


def _score(fails: str) -> str:
    return f"round(greatest(CAST(0 AS DOUBLE), CAST(100 AS DOUBLE) - 5 * {fails}), 1)"


def _report_sql(thr: float, with_acceptance: bool) -> str:
    cols = EVENT_COLS
    fails = _fails(cols, thr)
    all_ok = f"({fails} = 0 AND _rows - _distinct = 0 AND {_fresh(AS_OF, 2)}"
    if with_acceptance:
        all_ok += " AND _rows >= 1000 AND false"  # value is no decimal(12,2)
    all_ok += ")"

    def row(check, column, observed, threshold, passed):
        col_sql = "CAST(NULL AS VARCHAR)" if column is None else f"'{column}'"
        thr_sql = "CAST(NULL AS DOUBLE)" if threshold is None else f"CAST({threshold} AS DOUBLE)"
        return f"SELECT '{check}' AS check, {col_sql} AS column_name, CAST({observed} AS DOUBLE) AS observed, {thr_sql} AS threshold, {passed} AS passed FROM p"

    rows = [row("null_rate", c, f"round({_rate(i)}, 6)", thr, f"{_rate(i)} <= {thr}") for i, c in enumerate(cols)]
    rows.append(row("duplicates", "event_id", "_rows - _distinct", 0.0, "_rows - _distinct = 0"))
    rows.append(row("freshness", "ts", f"round({_lag(AS_OF)}, 6)", 2.0, _fresh(AS_OF, 2)))
    if with_acceptance:
        rows.append(row("min_rows", None, "_rows", 1000.0, "_rows >= 1000"))
        rows.append(row("expected_columns", None, "0", 0.0, "true"))
        rows.append(row("schema_drift", "value", "1", 0.0, "false"))
    rows.append(row("dq_score", None, _score(fails), None, f"{fails} = 0"))
    rows.append(row("all_checks", None, "_rows", None, all_ok))
    return (
        f"WITH {EVENTS_NULLS}, p AS ({_one_pass('events_nulls', cols, 'event_id', 'ts')})\n"
        + "\nUNION ALL\n".join(rows)
    )


def _expectations_sql() -> str:
    cols, thr = EVENT_COLS, 0.005
    fails = _fails(cols, thr)

    def row(crit, met, observed, expected):
        exp = "CAST(NULL AS DOUBLE)" if expected is None else f"CAST({expected} AS DOUBLE)"
        return f"SELECT '{crit}' AS criterion, {met} AS met, CAST({observed} AS DOUBLE) AS observed, {exp} AS expected FROM p"

    rows = [row("min_rows", "_rows >= 1000", "_rows", 1000), row("expected_columns", "true", "0", 0)]
    rows += [row(f"null_rate:{c}", f"{_rate(i)} <= {thr}", f"round({_rate(i)}, 6)", thr) for i, c in enumerate(cols)]
    rows.append(row("duplicates:event_id", "_rows - _distinct = 0", "_rows - _distinct", 0))
    rows.append(row("freshness:ts", _fresh(AS_OF, 2), f"round({_lag(AS_OF)}, 6)", 2))
    all_ok = f"({fails} = 0 AND _rows - _distinct = 0 AND {_fresh(AS_OF, 2)} AND _rows >= 1000 AND false)"  # the drift of value
    rows.append(row("all", all_ok, "NULL", None))
    return f"WITH {EVENTS_NULLS}, p AS ({_one_pass('events_nulls', cols, 'event_id', 'ts')})\n" + "\nUNION ALL\n".join(rows)


def _null_rates_sql() -> str:
    cols = EVENT_COLS
    rows = [
        f"SELECT '{c}' AS column_name, _n{i} AS null_count, _rows AS total_rows, {_rate(i)} AS null_rate, "
        f"CAST(0.01 AS DOUBLE) AS threshold, {_rate(i)} <= 0.01 AS passed FROM p"
        for i, c in enumerate(cols)
    ]
    return f"WITH {EVENTS_NULLS}, p AS ({_one_pass('events_nulls', cols)})\n" + "\nUNION ALL\n".join(rows)


def _dq_score_sql() -> str:
    cols = EVENT_COLS
    fails = _fails(cols, 0.01)
    return (
        f"WITH {EVENTS_NULLS}, p AS ({_one_pass('events_nulls', cols, 'event_id')})\n"
        f"SELECT _rows AS total_rows, {fails} AS null_failures, {_score(fails)} AS dq_score, {fails} = 0 AS passed, "
        f"_rows - _distinct AS duplicate_count, CAST(NULL AS BOOLEAN) AS fresh, "
        f"({fails} = 0 AND _rows - _distinct = 0) AS all_checks_passed FROM p"
    )


def _schema_profile_sql() -> str:
    types = ["bigint", "timestamp_ntz", "bigint", "string", "double", "string"]
    rows = [
        f"SELECT {i + 1} AS position, '{c}' AS column_name, '{t}' AS data_type, true AS nullable, _rows AS total_rows, "
        f"_n{i} AS null_count, _rows - _n{i} AS non_null_count FROM p"
        for i, (c, t) in enumerate(zip(EVENT_COLS, types))
    ]
    return f"WITH {EVENTS_NULLS}, p AS ({_one_pass('events_nulls', EVENT_COLS)})\n" + "\nUNION ALL\n".join(rows)


def _schema_drift_sql() -> str:
    fixed = [
        ("o_orderkey", "bigint", "bigint", "unchanged"),
        ("o_custkey", "bigint", "string", "type_changed"),
        ("o_orderstatus", "string", None, "removed"),
        ("o_totalprice", "double", "double", "unchanged"),
        ("o_orderdate", "timestamp_ntz", "timestamp_ntz", "unchanged"),
        ("o_orderpriority", "string", "string", "unchanged"),
    ]

    def lit(v):
        return "CAST(NULL AS VARCHAR)" if v is None else f"'{v}'"

    rows = [
        f"SELECT '{c}' AS column_name, {lit(e)} AS expected_type, {lit(a)} AS actual_type, '{ch}' AS change, CAST(NULL AS BIGINT) AS non_null_count"
        for c, e, a, ch in fixed
    ]
    rows.append(
        "SELECT 'note', CAST(NULL AS VARCHAR), 'string', 'added', "
        "count(*) FILTER (WHERE o_orderpriority = '1-URGENT') FROM orders"
    )
    return "\nUNION ALL\n".join(rows)


def _cast_input() -> str:
    return "oc AS (SELECT *, substring(o_orderpriority, 1, 1) AS prio_code, substring(o_orderpriority, 3, 100) AS prio_word FROM orders)"


def _cast_failures_sql() -> str:
    casts = [("prio_code", "int", "INTEGER"), ("prio_word", "int", "INTEGER"), ("o_totalprice", "decimal(12,2)", "DECIMAL(12,2)"), ("o_orderdate", "date", "DATE")]
    rows = [
        f"SELECT '{c}' AS column_name, '{name}' AS target_type, "
        f"count(*) FILTER (WHERE {c} IS NOT NULL AND TRY_CAST({c} AS {sql}) IS NULL) AS failed_count, count(*) AS total_rows FROM oc"
        for c, name, sql in casts
    ]
    return f"WITH {_cast_input()}\n" + "\nUNION ALL\n".join(rows)


def _freshness_sql() -> str:
    def one(as_of):
        return (
            f"SELECT TIMESTAMP '{as_of}' AS as_of, _max_ts AS max_ts, round({_lag(as_of)}, 6) AS lag_hours, "
            f"CAST(2 AS DOUBLE) AS max_age_hours, {_fresh(as_of, 2)} AS fresh FROM p"
        )

    return f"WITH p AS (SELECT max(ts) AS _max_ts FROM events)\n{one(AS_OF)}\nUNION ALL\n{one(AS_OF_STALE)}"


def _merge_sql() -> str:
    cols = ", ".join(ORDER_COLS)
    upd_cols = "o_orderkey, o_custkey, o_orderstatus, o_totalprice + {d} AS o_totalprice, o_orderdate, o_orderpriority, {v} AS version"
    return f"""WITH base AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'),
upd AS (
  SELECT {upd_cols.format(d=1, v=1)} FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'
  UNION ALL
  SELECT {upd_cols.format(d=2, v=2)} FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'),
latest AS (
  SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY version DESC) AS _rn FROM upd) WHERE _rn = 1)
SELECT {cols} FROM base b WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.o_orderkey = b.o_orderkey)
UNION ALL
SELECT {cols} FROM latest"""


def _quarantine_sql() -> str:
    errs = (
        "concat_ws(',', CASE WHEN value IS NULL THEN 'value_not_null' END, "
        "CASE WHEN user_id IS NULL THEN 'user_id_not_null' END, "
        "CASE WHEN NOT coalesce(value <= 400, false) THEN 'value_in_range' END)"
    )
    return f"WITH {EVENTS_NULLS}\nSELECT *, CASE WHEN dq_errors = '' THEN 'clean' ELSE 'quarantine' END AS status FROM (SELECT *, {errs} AS dq_errors FROM events_nulls)"


def _agg_sql() -> str:
    parts = ["l_returnflag", "l_linestatus", "count(*) AS row_count"]
    for m in ["l_quantity", "l_extendedprice", "l_discount"]:
        d = f"CAST({m} AS DECIMAL(15,2))"
        parts += [
            f"CAST(sum({d}) AS DECIMAL(18,2)) AS sum_{m}",
            f"round(CAST(avg({d}) AS DOUBLE), 6) AS avg_{m}",
            f"CAST(min({d}) AS DECIMAL(18,2)) AS min_{m}",
            f"CAST(max({d}) AS DECIMAL(18,2)) AS max_{m}",
        ]
    return f"SELECT {', '.join(parts)} FROM lineitem GROUP BY l_returnflag, l_linestatus"


def _chain_sql(source_name: str, with_dedupe: bool) -> str:
    src = _dedupe_sql("events_nulls", EVENT_COLS, ["event_id"]) if with_dedupe else "SELECT * FROM events_nulls"
    return (
        f"WITH {EVENTS_NULLS}, d AS ({src})\n"
        "SELECT event_id, ts, coalesce(user_id, -1) AS user_id, event_type, "
        "coalesce(TRY_CAST(value AS DECIMAL(12,2)), CAST(0 AS DECIMAL(12,2))) AS value, props, "
        f"'{source_name}' AS _source, true AS has_ingestion_ts FROM d"
    )


def _lineage_edges_sql() -> str:
    return (
        "SELECT 'o_year=' || CAST(year(o_orderdate) AS VARCHAR) AS source, 'o_orderstatus=' || o_orderstatus AS target, "
        "count(*) AS rows FROM orders GROUP BY 1, 2"
    )


def _lineage_nodes_sql() -> str:
    return (
        "SELECT 'o_year=' || CAST(year(o_orderdate) AS VARCHAR) AS node, 'source' AS kind, count(*) AS rows FROM orders GROUP BY 1\n"
        "UNION ALL\n"
        "SELECT 'o_orderstatus=' || o_orderstatus AS node, 'sink' AS kind, count(*) AS rows FROM orders GROUP BY 1"
    )


def _run_metrics_sql() -> str:
    keys = ", ".join(LINEITEM_KEYS)
    return (
        f"WITH i AS (SELECT count(*) AS n FROM lineitem), o AS (SELECT count(*) AS n FROM (SELECT DISTINCT {keys} FROM lineitem))\n"
        "SELECT i.n AS rows_in, o.n AS rows_out, i.n - o.n AS rows_removed FROM i, o"
    )


def _csv_inferred_sql() -> str:
    types = ["int", "int", "string", "double", "timestamp", "string"]
    return "\nUNION ALL\n".join(
        f"SELECT {i + 1} AS position, '{c}' AS column_name, '{t}' AS data_type, count({c}) AS non_null_count FROM orders"
        for i, (c, t) in enumerate(zip(ORDER_COLS, types))
    )


def _case_sql(part: str, raised: str) -> str:
    """orders with a partition column; the price of some rows raised by one."""
    return (
        f"SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN {raised} THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, "
        f"o_orderdate, o_orderpriority, p FROM (SELECT *, {part} AS p FROM orders)"
    )


def _layout_sql() -> str:
    tiers = " ".join(f"WHEN total_bytes < {limit} THEN {parts}" for limit, parts in SIZE_TIERS)
    return (
        "WITH s AS (SELECT o_orderkey, CAST(step AS INTEGER) AS step, CAST(floor(o_totalprice) AS BIGINT) * CAST(pow(100, step) AS BIGINT) AS total_bytes FROM orders, range(5) t(step))\n"
        f"SELECT o_orderkey, step, total_bytes, CAST(greatest(CASE {tiers} ELSE {LARGEST_TIER_PARTITIONS} END, ceil(total_bytes / CAST({TARGET_PARTITION_BYTES} AS DOUBLE))) AS INTEGER) AS partitions FROM s"
    )


MIGRATION_SOURCE = "migration_source AS (SELECT *, CASE WHEN o_orderkey % 100 = 0 THEN 'none' ELSE substring(o_orderpriority, 1, 1) END AS priority_code FROM orders)"


def _migration_changes_sql() -> str:
    return f"""WITH {MIGRATION_SOURCE}, n AS (SELECT count(*) FILTER (TRY_CAST(priority_code AS INTEGER) IS NULL) AS lost FROM migration_source)
SELECT v.column_name, v.source_name, v.change, v.from_type, v.to_type,
    CASE WHEN v.change = 'dropped' THEN NULL WHEN v.column_name = 'priority_code' THEN lost ELSE 0 END::BIGINT AS lost_values,
    CASE WHEN v.change = 'dropped' THEN NULL WHEN v.column_name = 'priority_code' THEN lost ELSE 0 END::BIGINT AS null_values
FROM n, (VALUES
    ('order_id', 'o_orderkey', 'renamed', 'bigint', 'bigint'),
    ('customer', 'o_custkey', 'cast', 'bigint', 'string'),
    ('day', 'o_orderdate', 'cast', 'timestamp_ntz', 'date'),
    ('price', 'o_totalprice', 'cast', 'double', 'decimal(12,2)'),
    ('priority_code', 'priority_code', 'cast', 'string', 'int'),
    ('channel', NULL, 'added', NULL, 'string'),
    ('o_orderstatus', 'o_orderstatus', 'kept', 'string', 'string'),
    (NULL, 'o_orderpriority', 'dropped', 'string', NULL)
) AS v(column_name, source_name, change, from_type, to_type)"""


def _aggregation_sql() -> str:
    stats = ", ".join(
        f"count({m}) AS count_{m}, sum({m})::{t} AS sum_{m}, min({m})::{t} AS min_{m}, max({m})::{t} AS max_{m}, sum({m})::DOUBLE / nullif(count({m}), 0) AS avg_{m}"
        for m, t in (("value", "DOUBLE"), ("user_id", "BIGINT"))
    )
    exact = "exact AS (SELECT * REPLACE (CAST(value AS DECIMAL(12,2)) AS value) FROM events_nulls)"
    return f"WITH {EVENTS_NULLS}, {exact} SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS row_count, {stats} FROM exact GROUP BY 1, 2"


def oracle_sql() -> dict[str, str]:
    etl = _chain_sql("etl", True).replace(
        "'etl' AS _source, true AS has_ingestion_ts", "'etl' AS _source, CAST(ts AS DATE) AS date, true AS has_ingestion_ts"
    )
    return {
        "dedupe_keys": _dedupe_sql("lineitem", LINEITEM_COLS, LINEITEM_KEYS),
        "row_count": "SELECT count(*) AS row_count FROM lineitem",
        "aggregate_by_keys": _agg_sql(),
        "fill_nulls": f"WITH {EVENTS_NULLS}\nSELECT event_id, ts, coalesce(user_id, -1) AS user_id, event_type, coalesce(value, CAST(0 AS DOUBLE)) AS value, props FROM events_nulls",
        "cast_types": (
            f"WITH {_cast_input()}\nSELECT o_orderkey, o_custkey, o_orderstatus, TRY_CAST(o_totalprice AS DECIMAL(12,2)) AS o_totalprice, "
            "TRY_CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority, TRY_CAST(prio_code AS INTEGER) AS prio_code, "
            "TRY_CAST(prio_word AS INTEGER) AS prio_word FROM oc"
        ),
        "cast_failures": _cast_failures_sql(),
        "audit_columns": "SELECT *, 'sluice' AS _source, true AS has_ingestion_ts FROM orders",
        "transform_chain": _chain_sql("events", True),
        "migrate_schema": (
            "SELECT o_orderkey AS order_id, CAST(o_custkey AS VARCHAR) AS customer_id, CAST(o_orderdate AS DATE) AS o_orderdate, "
            "o_totalprice, o_orderpriority AS priority, 'migrated' AS note FROM orders"
        ),
        "migration_flow": (
            f"WITH {MIGRATION_SOURCE} SELECT o_orderkey AS order_id, CAST(o_custkey AS VARCHAR) AS customer, CAST(o_orderdate AS DATE) AS day, "
            "CAST(o_totalprice AS DECIMAL(12,2)) AS price, TRY_CAST(priority_code AS INTEGER) AS priority_code, 'web' AS channel, o_orderstatus FROM migration_source"
        ),
        "migration_changes": _migration_changes_sql(),
        "aggregation_flow": _aggregation_sql(),
        "aggregation_add": _aggregation_sql(),
        "repartition_rows": "SELECT * FROM orders",
        "partition_skew": "SELECT CAST(8 AS BIGINT) AS partitions, count(*) AS total_rows, true AS none_empty FROM orders",
        "dq_null_rates": _null_rates_sql(),
        "dq_duplicates": (
            f"WITH {EVENTS_NULLS}, p AS (SELECT count(*) AS _rows, count(DISTINCT user_id) + max(CASE WHEN user_id IS NULL THEN 1 ELSE 0 END) AS _distinct FROM events_nulls)\n"
            "SELECT 'user_id' AS key_columns, _rows AS total_rows, _distinct AS distinct_keys, _rows - _distinct AS duplicate_count, "
            "_rows - _distinct = 0 AS passed FROM p"
        ),
        "dq_score": _dq_score_sql(),
        "dq_report": _report_sql(0.005, with_acceptance=True),
        "expectations": _expectations_sql(),
        "dq_freshness": _freshness_sql(),
        "dq_quarantine": _quarantine_sql(),
        "schema_profile": _schema_profile_sql(),
        "schema_drift": _schema_drift_sql(),
        "merge_upsert": _merge_sql(),
        "merge_partitions": (
            "SELECT o_orderkey, o_custkey, o_orderstatus, "
            "CASE WHEN o_orderdate >= TIMESTAMP '2000-01-01' THEN o_totalprice + 2 ELSE o_totalprice END AS o_totalprice, "
            "o_orderdate, o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS o_year FROM orders"
        ),
        "write_readback": "SELECT * FROM orders",
        "overwrite_partitions": (
            "SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, "
            "o_orderdate, o_orderpriority FROM orders"
        ),
        "partition_manifest": "SELECT 'event_type=' || event_type AS partition, count(*) AS rows FROM events GROUP BY event_type",
        "write_metrics": "SELECT count(*) AS rows_written, true AS files_agree, true AS bytes_agree FROM events",
        "scan_csv": "SELECT * FROM orders",
        "scan_csv_inferred": _csv_inferred_sql(),
        "scan_parquet_merged": "SELECT *, CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN 'late' END AS note FROM orders",
        "scan_orc": "SELECT * FROM orders",
        "scan_json": "SELECT * FROM events",
        "source_inventory": (
            "SELECT * FROM (VALUES ('csv', CAST(2 AS BIGINT), true), ('json', CAST(2 AS BIGINT), true), "
            "('orc', CAST(2 AS BIGINT), true), ('parquet', CAST(2 AS BIGINT), true)) t(format, files, has_bytes)"
        ),
        "sink_layout": _layout_sql(),
        "lineage_edges": _lineage_edges_sql(),
        "lineage_nodes": _lineage_nodes_sql(),
        "run_metrics": _run_metrics_sql(),
        "etl_flow": etl,
        "dq_suite": f"SELECT r.*, u.run_id FROM ({_report_sql(0.005, with_acceptance=False)}) r, (VALUES ('first'), ('second')) u(run_id)",
        "stream_ingest_hourly": "SELECT *, strftime(ts, '%Y-%m-%d-%H') AS hour FROM events",
        "stream_dedupe": "SELECT * FROM events",
        "merge_zero_padded": _case_sql("strftime(o_orderdate, '%m')", "p <= '03'"),
        "merge_null_partition": _case_sql("CASE WHEN o_orderpriority <> '1-URGENT' THEN substring(o_orderpriority, 1, 1) END", "o_orderkey % 3 = 0 AND coalesce(p < '3', true)"),
        "merge_moved_keys": (
            "SELECT o_orderkey, o_custkey, CASE o_orderstatus WHEN 'O' THEN 'F' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, "
            "CASE o_orderstatus WHEN 'O' THEN 'F' ELSE o_orderstatus END AS p FROM orders"
        ),
        "etl_upsert": (
            "SELECT o_orderkey, o_custkey, CASE WHEN late THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice + CASE WHEN late THEN 3 ELSE 1 END AS o_totalprice, "
            "o_orderdate, o_orderpriority FROM (SELECT *, o_orderdate >= TIMESTAMP '2000-01-01' AS late FROM orders)"
        ),
        "csv_bad_rows": "SELECT o_orderkey, o_orderkey % 100 <> 0 AS good FROM orders",
        "etl_delimited": "SELECT * FROM orders",
        "etl_merge_schema": "SELECT *, CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN 'late' END AS note FROM orders",
        "etl_cast_losses": (
            f"WITH {_cast_input()}, n AS (SELECT count(*) FILTER (WHERE TRY_CAST(prio_code AS INTEGER) IS NULL AND prio_code IS NOT NULL) AS a, "
            "count(*) FILTER (WHERE TRY_CAST(prio_word AS INTEGER) IS NULL AND prio_word IS NOT NULL) AS b, count(*) AS c FROM oc)\n"
            "SELECT 'cast_loss' AS \"check\", 'prio_code' AS column_name, a AS observed, a = 0 AS passed FROM n\n"
            "UNION ALL SELECT 'cast_loss', 'prio_word', b, b = 0 FROM n\n"
            "UNION ALL SELECT 'all_checks', NULL, c, a = 0 AND b = 0 FROM n"
        ),
        "stream_kafka_json": (
            "SELECT event_id AS message, CASE WHEN ok THEN event_id END AS event_id, CASE WHEN ok THEN ts END AS ts, CASE WHEN ok THEN user_id END AS user_id, "
            "CASE WHEN ok THEN event_type END AS event_type, CASE WHEN ok THEN value END AS value, NOT ok AS corrupt FROM (SELECT *, event_id % 100 <> 0 AS ok FROM events)"
        ),
        "stream_transform_chain": (
            f"WITH {EVENTS_NULLS}\nSELECT event_id, ts, coalesce(user_id, -1) AS user_id, event_type, coalesce(value, CAST(0 AS DOUBLE)) AS value, "
            "props, 'stream' AS _source, true AS has_ingestion_ts FROM events_nulls"
        ),
    }
