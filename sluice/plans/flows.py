"""F1 batch ETL and F3 DQ suite as fixed-order functions over a typed spec.

A spec builds ONE lazy plan (scan -> steps). Jobs per run:
* ``gate="off"``: the write job only.
* otherwise, staged: the cleaned table is written ONCE to a staging folder under the shared checkpoint
  folder; the gate and the final write read that columnar copy, so the source is scanned
  once and the steps' shuffles (dedupe) run once. Both gates judge the rows of this run, never
  older rows of the target.
* ``stage=False``: not staged. A blocking gate then runs the steps once for its null counts, once
  for its distinct keys and once for the write; cheaper than a staged copy only for light steps. ``stage=None`` (default)
  stages when a step shuffles.
Staged copies (``etl-stage``, ``etl-quarantine-stage``) are full copies of the cleaned batch, kept for replaying a publish;
they expire with the shared folder's own retention.
Row counts at the source and the sink are observed inside the write jobs.
"""

from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from sluice.functions import named
from sluice.operators.chain import apply_steps, step_name
from sluice.operators.transforms import cast_failures
from sluice.plans.lineage import SOURCE_FILE, RunMetrics, observed_rows, run_with_metrics
from sluice.quality.checks import REPORT_SCHEMA, dq_report
from sluice.quality.quarantine import ERRORS, STATUS, tag_rows
from sluice.quality.rules import DQRules
from sluice.session import scratch_path
from sluice.sinks.merge import latest_updates, merge_partitions
from sluice.sinks.writer import WriteResult, write_table
from sluice.sources.files import read_table, split_corrupt

SHUFFLING_STEPS = {"deduplicate"}
GATES = ("block", "report", "off")
MERGE_MODES = ("merge", "upsert")  # the original's CLI accepted both; here they are one keyed upsert


class DQGateError(RuntimeError):
    def __init__(self, report: list[Row]):
        self.report = report
        failed = [f"{r['check']}:{r['column_name']}" for r in report if r["passed"] is False]
        super().__init__(f"data-quality gate failed: {failed}")


@dataclass(frozen=True)
class PipelineSpec:
    source_path: str
    target_path: str
    source_format: str = "parquet"
    source_schema: Any = None
    target_format: str = "parquet"
    write_mode: str = "append"
    partition_cols: tuple[str, ...] = ()
    steps: tuple[Any, ...] = ()
    rules: Mapping[str, Any] | None = None
    gate: str = "block"
    gate_on: str = "dq_score"  # 'dq_score' (null-rate failures only) or 'all_checks'
    lineage: bool = False
    overwrite_partitions: bool = False
    stage: bool | None = None  # None: stage when a step shuffles
    merge_keys: tuple[str, ...] = ()
    merge_order_by: tuple[str, ...] = ()
    merge_delete_col: str | None = None
    keys_may_move: bool = True  # an updated key may sit in another partition of the target
    source_options: Mapping[str, str] | None = None
    target_options: Mapping[str, str] | None = None
    merge_schema: bool = False
    sampling_ratio: float | None = None
    corrupt_path: str | None = None  # csv / json with a schema: malformed records go there instead of raising
    quarantine_rules: Mapping[str, str] | None = None  # rule name -> SQL condition rows must meet
    quarantine_path: str | None = None
    exact_counts: bool = False  # count the source in its own job (exact even after stage re-runs)

    def __post_init__(self):
        if self.gate not in GATES:
            raise ValueError(f"gate must be one of {GATES}")
        if self.write_mode in MERGE_MODES and not (self.merge_keys and self.partition_cols):
            raise ValueError("write_mode merge / upsert needs merge_keys and partition_cols (only touched partitions are rewritten)")
        if bool(self.quarantine_rules) != bool(self.quarantine_path):
            raise ValueError("quarantine_rules and quarantine_path go together")
        object.__setattr__(self, "merge_keys", tuple(self.merge_keys))
        object.__setattr__(self, "merge_order_by", tuple(self.merge_order_by))
        if self.gate_on not in ("dq_score", "all_checks"):
            raise ValueError("gate_on must be 'dq_score' or 'all_checks'")
        object.__setattr__(self, "partition_cols", tuple(self.partition_cols))
        object.__setattr__(self, "steps", tuple(self.steps))


@dataclass(frozen=True)
class EtlResult:
    write: WriteResult | None
    metrics: RunMetrics | None
    report: list[Row] = field(default_factory=list)
    passed: bool = True
    quarantined: WriteResult | None = None
    staging_path: str | None = None  # staged cleaned table; publish can be replayed from it
    cast_losses: dict[str, int] = field(default_factory=dict)  # per cast column: values that became NULL
    corrupt: WriteResult | None = None  # malformed records, with corrupt_path


def _gate_passed(report: list[Row], gate_on: str) -> bool:
    wanted = [r for r in report if r["check"] == gate_on]
    return bool(wanted) and all(r["passed"] for r in wanted)


def read_source(spark: SparkSession, spec: PipelineSpec) -> DataFrame:
    return read_table(
        spark, spec.source_path, spec.source_format, schema=spec.source_schema, merge_schema=spec.merge_schema, options=spec.source_options,
        with_source_file=spec.lineage, sampling_ratio=spec.sampling_ratio, keep_corrupt=spec.corrupt_path is not None,
    )


def build_plan(spark: SparkSession, spec: PipelineSpec) -> DataFrame:
    src = read_source(spark, spec)
    return apply_steps(split_corrupt(src)[0] if spec.corrupt_path else src, spec.steps)


def _target_exists(spark: SparkSession, spec: PipelineSpec) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(spec.target_path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _publish(spark: SparkSession, df: DataFrame, spec: PipelineSpec) -> WriteResult:
    """Write by the spec's mode: append / overwrite (dynamic per partition if asked), or a
    keyed upsert that rewrites only the touched partitions of an existing target."""
    parts = list(spec.partition_cols)
    if spec.write_mode in MERGE_MODES:
        keys, order = list(spec.merge_keys), list(spec.merge_order_by) or None
        if _target_exists(spark, spec):
            return merge_partitions(
                spark, spec.target_path, df, keys, parts, format=spec.target_format, order_by=order, keys_may_move=spec.keys_may_move, delete_col=spec.merge_delete_col
            )
        # the first load: the same survivors as an update batch
        first = latest_updates(df, keys, order)
        if spec.merge_delete_col:
            first = first.where(~F.coalesce(named(spec.merge_delete_col), F.lit(False)))
        result = write_table(first, spec.target_path, format=spec.target_format, mode="error", partition_cols=parts, options=spec.target_options)
        return dataclasses.replace(result, rows_inserted=result.rows_written, rows_updated=0)
    return write_table(
        df, spec.target_path, format=spec.target_format, mode=spec.write_mode, partition_cols=parts, overwrite_partitions=spec.overwrite_partitions, options=spec.target_options
    )


def _metrics(rows_in: int, published: WriteResult) -> RunMetrics:
    """Rows of this batch that reached the target: for an upsert its inserts and updates, not every rewritten row."""
    upsert = published.rows_updated is not None
    return RunMetrics(rows_in=rows_in, rows_out=published.rows_inserted + published.rows_updated if upsert else published.rows_written, write=published)


def cast_targets(steps: Sequence[Any]) -> dict[str, str]:
    """Columns that a cast step converts, if no earlier step made or changed them."""
    for step in steps:
        if step_name(step) == "cast_types":
            return dict(step["types"])
        if step_name(step) not in ("deduplicate", "add_audit_columns"):
            break
    return {}


def _cast_losses(src: DataFrame, spec: PipelineSpec) -> dict[str, int]:
    """Values of the source that a cast turns into NULL (a later fill would hide them from the gate)."""
    types = {c: t for c, t in cast_targets(spec.steps).items() if c in src.columns}
    if not types:
        return {}
    return {r["column_name"]: int(r["failed_count"]) for r in cast_failures(src, types).collect()}


def _with_losses(report: list[Row], losses: Mapping[str, int]) -> list[Row]:
    """Report rows for cast losses, before the two summary rows; a loss fails ``all_checks``."""
    if not report or not losses:
        return report
    names = list(report[0].asDict())
    make = Row(*names)
    extra = [make("cast_loss", c, float(n), 0.0, n == 0) for c, n in losses.items()]
    lost = any(losses.values())
    summary = [make(*(False if f == "passed" and r["check"] == "all_checks" and lost else r[f] for f in names)) for r in report[-2:]]
    return [*report[:-2], *extra, *summary]


def _dq(df: DataFrame, rules: DQRules, losses: Mapping[str, int]) -> list[Row]:
    checked = df.drop(SOURCE_FILE) if SOURCE_FILE in df.columns else df
    return _with_losses(dq_report(checked, rules).collect(), losses)  # C + 3 rows


def run_etl(spark: SparkSession, spec: PipelineSpec) -> EtlResult:
    """read -> steps -> DQ gate -> partitioned write (append / overwrite / upsert), with
    observed row counts, cast losses and, on request, malformed and quarantined rows apart."""
    src, corrupt = read_source(spark, spec), None
    if spec.corrupt_path:
        src, bad = split_corrupt(src)
        corrupt = write_table(bad, spec.corrupt_path, mode="append")
    rules = DQRules.from_dict(spec.rules) if spec.rules is not None else None
    gated = rules is not None and spec.gate != "off"
    losses = _cast_losses(src, spec) if gated else {}
    shuffles = any(step_name(s) in SHUFFLING_STEPS for s in spec.steps)
    stage = spec.stage if spec.stage is not None else gated and (shuffles or spec.gate == "report")

    if spec.quarantine_rules:
        return dataclasses.replace(_run_with_quarantine(spark, spec, src, rules, losses), corrupt=corrupt)
    report: list[Row] = []
    if gated and (stage or spec.gate == "report"):
        staged_path = scratch_path(spark, "etl-stage")
        schema = apply_steps(src, spec.steps).schema
        staged_run = run_with_metrics(src, lambda df: apply_steps(df, spec.steps), staged_path, exact_source_count=spec.exact_counts, mode="error")
        staged = spark.read.schema(schema).parquet(staged_path)
        report = _dq(staged, rules, losses)
        if spec.gate == "block" and not _gate_passed(report, spec.gate_on):
            raise DQGateError(report)
        published = _publish(spark, staged, spec)
        return EtlResult(write=published, metrics=_metrics(staged_run.rows_in, published), report=report, passed=_gate_passed(report, spec.gate_on), staging_path=staged_path, cast_losses=losses, corrupt=corrupt)

    if gated:
        report = _dq(apply_steps(src, spec.steps), rules, losses)
        if not _gate_passed(report, spec.gate_on):
            raise DQGateError(report)
    if spec.exact_counts or spec.write_mode in MERGE_MODES:
        # an upsert reads its batch in more than one job: an observation would see only the first
        published, rows_in = _publish(spark, apply_steps(src, spec.steps), spec), src.count()
    else:
        obs_in = Observation("sluice_etl_rows_in")
        published = _publish(spark, apply_steps(src.observe(obs_in, F.count(F.lit(1)).alias("rows")), spec.steps), spec)
        rows_in = observed_rows(obs_in, src)
    return EtlResult(write=published, metrics=_metrics(rows_in, published), report=report, passed=True, cast_losses=losses, corrupt=corrupt)


def _run_with_quarantine(spark, spec: PipelineSpec, src: DataFrame, rules: DQRules | None, losses: Mapping[str, int]) -> EtlResult:
    """Q6 in the flow: rows breaking a quarantine rule go to ``quarantine_path`` with their
    ``_dq_errors``; the rest is gated (on the clean rows) and published. The steps run once:
    one job writes both sides to a staging folder partitioned by status, and the publish
    jobs read that staged copy."""
    staged_path = scratch_path(spark, "etl-quarantine-stage")
    tagged = lambda df: tag_rows(apply_steps(df, spec.steps), spec.quarantine_rules)
    staged_run = run_with_metrics(src, tagged, staged_path, exact_source_count=spec.exact_counts, mode="error", partition_cols=[STATUS])
    staged = spark.read.schema(tagged(src).schema).parquet(staged_path)  # a known schema: the batch may be empty
    clean = staged.filter(F.col(STATUS) == "clean").drop(STATUS, ERRORS)
    bad = staged.filter(F.col(STATUS) == "quarantine").drop(STATUS)
    report: list[Row] = []
    if rules is not None and spec.gate != "off":
        report = _dq(clean, rules, losses)
        if spec.gate == "block" and not _gate_passed(report, spec.gate_on):
            raise DQGateError(report)
    published = _publish(spark, clean, spec)
    quarantined = write_table(bad, spec.quarantine_path, mode="append")
    passed = _gate_passed(report, spec.gate_on) if report else True
    return EtlResult(write=published, metrics=_metrics(staged_run.rows_in, published), report=report, passed=passed, quarantined=quarantined, staging_path=staged_path, cast_losses=dict(losses))


def report_frame(spark: SparkSession, report: Sequence[Row]) -> DataFrame:
    return spark.createDataFrame(list(report), REPORT_SCHEMA)


def run_dq_suite(
    df: DataFrame,
    rules: Mapping[str, Any] | DQRules,
    report_path: str | None = None,
    report_format: str = "parquet",
    run_id: str | None = None,
) -> tuple[DataFrame, WriteResult | None]:
    """null rates, duplicates and freshness in one pass; the report is published (K7)
    to ``report_path`` when given: each run appends its rows with ``run_id`` (a new one by default) and
    ``run_at``. Returns the report frame of this run and the write result."""
    report = dq_report(df, rules)
    if report_path is None:
        return report, None
    run_id = run_id or uuid.uuid4().hex
    stamped = report.withColumns({"run_id": F.lit(run_id), "run_at": F.current_timestamp()})
    result = write_table(stamped, report_path, format=report_format, mode="append")
    written = read_table(df.sparkSession, report_path, report_format, schema=stamped.schema)
    return written.where(F.col("run_id") == run_id).drop("run_id", "run_at"), result
