"""Command line: ``python -m sluice {run,dq,stream,migrate,aggregate} ...`` (or through ``spark-submit``).

* ``run``    F1: read -> steps -> DQ gate -> write (append / overwrite / upsert).
* ``dq``     F3: one-pass DQ report over a table, published to a report path (DQ-suite preset:
  null threshold 0.005, duplicates, and a 2-hour freshness check when a time column is given).
* ``stream`` F2: files arriving in a folder, or a Kafka topic -> hourly (or daily) parquet, drained now.
* ``migrate`` F4: a table copied into another schema, refused if values would be lost.
* ``aggregate`` F5: an aggregate table, computed anew or with a batch added to it.

The session comes from ``SparkSession.builder.getOrCreate()``: cluster settings belong to
``spark-submit`` / ``spark-defaults.conf``, not to this tool.
"""

from __future__ import annotations

import argparse
import json
import sys

from sluice.quality.rules import DQ_SUITE_RULES

# The transformation list of the original tool's ETL goal, in its order.
DEFAULT_STEPS = ["deduplicate", "cast_types", "fill_nulls", "add_audit_columns"]


def _pairs(options: list[str]) -> dict[str, str]:
    return dict(o.split("=", 1) for o in options)


def _csv(text: str | None) -> list[str]:
    return [t for t in (text or "").split(",") if t]


def _steps(args) -> list:
    """Step names, with the arguments the CLI flags provide."""
    steps = []
    for name in _csv(args.steps) if args.steps is not None else DEFAULT_STEPS:
        if name == "deduplicate":
            steps.append({"op": name, "keys": _csv(args.dedup_keys) or None, "order_by": _csv(args.order_by) or None, "keep": args.keep})
        elif name == "cast_types":
            types = json.loads(args.cast or "{}")
            if types:
                steps.append({"op": name, "types": types})
        elif name == "fill_nulls":
            values = json.loads(args.fill or "{}")
            if values:
                steps.append({"op": name, "values": values})
        elif name == "add_audit_columns":
            steps.append({"op": name, "source_name": args.source_name})
        elif name == "derive_columns":
            steps.append({"op": name, "exprs": json.loads(args.derive or "{}")})
        else:
            steps.append(name)  # unknown names raise in apply_steps
    return steps


def _rules(args) -> dict | None:
    if args.no_dq:
        return None
    rules = {"null_threshold": args.null_threshold, "dupe_check": not args.no_dupe_check}
    if args.dupe_keys:
        rules["dupe_keys"] = _csv(args.dupe_keys)
    hours = args.freshness_hours
    if hours is None and args.freshness_column and args.command == "dq":
        hours = DQ_SUITE_RULES["freshness_hours"]  # the DQ-suite preset checks freshness too
    if hours is not None:
        rules.update(freshness_hours=hours, freshness_column=args.freshness_column, as_of=args.as_of)
    return rules


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="python -m sluice", description=__doc__.split("\n\n")[0])
    sub = p.add_subparsers(dest="command", required=True)

    def dq_flags(sp, threshold=0.01):
        sp.add_argument("--null-threshold", type=float, default=threshold)
        sp.add_argument("--no-dupe-check", action="store_true")
        sp.add_argument("--dupe-keys", help="comma-separated; default: first column")
        sp.add_argument("--freshness-hours", type=float)
        sp.add_argument("--freshness-column")
        sp.add_argument("--as-of", help="timestamp the freshness check is measured from")

    run = sub.add_parser("run", help="batch ETL (F1)")
    run.add_argument("--source", required=True)
    run.add_argument("--target", required=True)
    run.add_argument("--input-format", default="csv", choices=["csv", "parquet", "orc", "json", "delta"])
    run.add_argument("--output-format", default="parquet", choices=["parquet", "orc", "json", "csv", "delta"])
    run.add_argument("--mode", default="append", choices=["append", "overwrite", "merge", "upsert"])
    run.add_argument("--partition-cols", default="")
    run.add_argument("--steps", help=f"comma-separated step names (default: {','.join(DEFAULT_STEPS)})")
    run.add_argument("--dedup-keys")
    run.add_argument("--order-by", help="dedupe order columns")
    run.add_argument("--keep", default="first", choices=["first", "last", "any"])
    run.add_argument("--cast", help='JSON, e.g. {"amount": "decimal(12,2)"}')
    run.add_argument("--fill", help='JSON, e.g. {"currency": "USD"}')
    run.add_argument("--derive", help='JSON, e.g. {"date": "to_date(event_ts)"}')
    run.add_argument("--source-name", default="sluice")
    run.add_argument("--merge-keys")
    run.add_argument("--merge-order-by", help="update columns; of several updates of a key the largest wins")
    run.add_argument("--merge-delete-col", help="boolean update column: true deletes the key")
    run.add_argument("--keys-stay", action="store_true", help="keys never change their partition (skips looking for them)")
    run.add_argument("--gate-on", default="dq_score", choices=["dq_score", "all_checks"])
    run.add_argument("--schema", help="DDL schema of the source; without it CSV and JSON types are inferred in an extra pass")
    run.add_argument("--sampling-ratio", type=float, help="share of the rows that type inference reads")
    run.add_argument("--merge-schema", action="store_true", help="parquet / orc: union of the files' schemas")
    run.add_argument("--source-option", action="append", default=[], metavar="NAME=VALUE")
    run.add_argument("--target-option", action="append", default=[], metavar="NAME=VALUE")
    run.add_argument("--corrupt-path", help="malformed CSV / JSON records go there (needs --schema)")
    run.add_argument("--gate", default="block", choices=["block", "report", "off"])
    run.add_argument("--stage", action=argparse.BooleanOptionalAction, help="stage the cleaned table once before the gate (default: if a step shuffles)")
    run.add_argument("--no-dq", action="store_true")
    dq_flags(run)

    dq = sub.add_parser("dq", help="DQ suite (F3)")
    dq.add_argument("--source", required=True)
    dq.add_argument("--input-format", default="parquet")
    dq.add_argument("--report", required=True, help="path the report table is written to")
    dq.add_argument("--no-dq", action="store_true", help=argparse.SUPPRESS)
    dq_flags(dq, threshold=DQ_SUITE_RULES["null_threshold"])  # the DQ-suite preset

    st = sub.add_parser("stream", help="stream ingest (F2) from a folder of arriving files or a Kafka topic")
    st.add_argument("--source", help="folder of arriving files (or use --kafka-servers/--topic)")
    st.add_argument("--kafka-servers")
    st.add_argument("--topic")
    st.add_argument("--value-schema", help="DDL schema of the JSON message value, e.g. 'id bigint, ts timestamp'")
    st.add_argument("--max-offsets-per-trigger", type=int)
    st.add_argument("--input-format", default="parquet")
    st.add_argument("--target", required=True)
    st.add_argument("--checkpoint", required=True)
    st.add_argument("--ts-column", required=True)
    st.add_argument("--grain", default="hour", choices=["hour", "day"])
    st.add_argument("--dedup-keys")
    st.add_argument("--delay", default="1 hour", help="watermark delay for --dedup-keys")
    st.add_argument("--max-files-per-trigger", type=int)

    def table_flags(sp):
        sp.add_argument("--source", required=True)
        sp.add_argument("--target", required=True)
        sp.add_argument("--input-format", default="parquet", choices=["csv", "parquet", "orc", "json", "delta"])
        sp.add_argument("--output-format", default="parquet", choices=["parquet", "orc", "json", "csv", "delta"])
        sp.add_argument("--schema", help="DDL schema of the source")
        sp.add_argument("--source-option", action="append", default=[], metavar="NAME=VALUE")
        sp.add_argument("--partition-cols", default="")

    mi = sub.add_parser("migrate", help="schema migration (F4)")
    table_flags(mi)
    mi.add_argument("--target-schema", required=True, help="DDL schema of the new version; NOT NULL is checked")
    mi.add_argument("--rename", action="append", default=[], metavar="OLD=NEW")
    mi.add_argument("--defaults", help='JSON values of added columns, e.g. {"channel": "web"}')
    mi.add_argument("--drop", help="comma-separated source columns that may go (default: any)")
    mi.add_argument("--on-loss", default="block", choices=["block", "report"])

    ag = sub.add_parser("aggregate", help="aggregate table (F5)")
    table_flags(ag)
    ag.add_argument("--keys", required=True)
    ag.add_argument("--measures", default="", help="comma-separated; default: every numeric column that is no key")
    ag.add_argument("--derive", help='JSON, e.g. {"day": "to_date(ts)"}')
    ag.add_argument("--mode", default="overwrite", choices=["overwrite", "add"])
    ag.add_argument("--batch-id", help="names the batch of --mode add; a batch is added once")
    return p


def main(argv: list[str] | None = None, spark=None) -> dict:
    args = build_parser().parse_args(argv)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName(f"sluice-{args.command}").getOrCreate()

    if args.command == "run":
        from sluice.plans import PipelineSpec, run_etl

        spec = PipelineSpec(
            source_path=args.source,
            source_format=args.input_format,
            target_path=args.target,
            target_format=args.output_format,
            write_mode=args.mode,
            partition_cols=tuple(_csv(args.partition_cols)),
            steps=tuple(_steps(args)),
            rules=_rules(args),
            gate=args.gate,
            stage=args.stage,
            merge_keys=tuple(_csv(args.merge_keys)),
            merge_order_by=tuple(_csv(args.merge_order_by)),
            merge_delete_col=args.merge_delete_col,
            keys_may_move=not args.keys_stay,
            gate_on=args.gate_on,
            source_schema=args.schema,
            source_options=_pairs(args.source_option),
            target_options=_pairs(args.target_option),
            merge_schema=args.merge_schema,
            sampling_ratio=args.sampling_ratio,
            corrupt_path=args.corrupt_path,
        )
        res = run_etl(spark, spec)
        out = {
            "status": "success",
            "target": args.target,
            "rows_in": res.metrics.rows_in,
            "rows_written": res.write.rows_written,
            "dq_passed": res.passed,
            "report": [r.asDict() for r in res.report],
        }
    elif args.command == "dq":
        from sluice.plans import run_dq_suite
        from sluice.sources import read_table

        report, written = run_dq_suite(read_table(spark, args.source, args.input_format), _rules(args), report_path=args.report)
        rows = [r.asDict() for r in report.collect()]  # C + 3 rows
        out = {"status": "success", "report_path": args.report, "rows_written": written.rows_written, "report": rows}
    elif args.command == "migrate":
        from sluice.plans import MigrationSpec, run_migration

        res = run_migration(spark, MigrationSpec(
            source_path=args.source, target_path=args.target, target_schema=args.target_schema, source_format=args.input_format, source_schema=args.schema,
            source_options=_pairs(args.source_option), target_format=args.output_format, renames=_pairs(args.rename), defaults=json.loads(args.defaults or "{}"),
            drops=None if args.drop is None else tuple(_csv(args.drop)), partition_cols=tuple(_csv(args.partition_cols)), on_loss=args.on_loss,
        ))
        out = {"status": "success", "target": args.target, "rows_in": res.metrics.rows_in, "rows_written": res.metrics.rows_out, "changes": [r.asDict() for r in res.changes]}
    elif args.command == "aggregate":
        from sluice.plans import AggregationSpec, run_aggregation

        derive = json.loads(args.derive or "{}")
        res = run_aggregation(spark, AggregationSpec(
            source_path=args.source, target_path=args.target, keys=tuple(_csv(args.keys)), measures=tuple(_csv(args.measures)), partition_cols=tuple(_csv(args.partition_cols)),
            mode=args.mode, batch_id=args.batch_id, source_format=args.input_format, source_schema=args.schema, source_options=_pairs(args.source_option),
            target_format=args.output_format, steps=({"op": "derive_columns", "exprs": derive},) if derive else (),
        ))
        out = {"status": "success", "target": args.target, "rows_written": res.write.rows_written, "added": res.added}
    else:
        from sluice.streaming import StreamSpec, read_file_stream, read_kafka_stream, run_stream_ingest

        if args.kafka_servers:
            if not (args.topic and args.value_schema):
                raise SystemExit("--kafka-servers needs --topic and --value-schema")
            stream = read_kafka_stream(spark, args.kafka_servers, args.topic, args.value_schema, max_offsets_per_trigger=args.max_offsets_per_trigger)
        elif args.source:
            schema = spark.read.format(args.input_format).load(args.source).schema
            stream = read_file_stream(spark, args.source, schema, format=args.input_format, max_files_per_trigger=args.max_files_per_trigger)
        else:
            raise SystemExit("stream needs --source or --kafka-servers/--topic")
        spec = StreamSpec(
            target_path=args.target,
            checkpoint=args.checkpoint,
            ts_col=args.ts_column,
            grain=args.grain,
            dedupe_keys=tuple(_csv(args.dedup_keys)),
            dedupe_delay=args.delay,
        )
        res = run_stream_ingest(stream, spec)
        out = {"status": "success", "target": args.target, "batches": res.batches, "input_rows": res.input_rows,
               "rows_dropped_by_watermark": res.rows_dropped_by_watermark}
    print(json.dumps(out, default=str))
    return out


if __name__ == "__main__":
    main(sys.argv[1:])
