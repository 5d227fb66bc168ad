"""F4 schema migration and F5 aggregation: the two remaining kinds of pipeline, as flows over a typed spec.

F4 (``run_migration``) copies a table into another schema: renames, casts, added, dropped and reordered columns. One
aggregate over the source counts, before anything is written, the values that a cast would lose and the NULLs that would reach a
column declared NOT NULL; then one job writes the new version and observes the rows on both sides.

F5 (``run_aggregation``) keeps an aggregate table: ``mode="overwrite"`` computes it anew, ``mode="add"`` adds a batch to it and
rewrites only the partitions the batch touches. Counts, sums, minima and maxima of the stored groups and of the batch
combine, so the cost follows the batch and never the history; averages are sums divided by counts. A batch is added once:
its result is staged, then noted under the table (``_sluice_batches``), then published, so a run that failed half-way is
finished from the staged copy (before any other batch is added) and a repeated run changes nothing. One writer at a time.
"""

from __future__ import annotations

import dataclasses
import hashlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions import as_list, named, require_columns
from sluice.operators.aggregate import aggregate_by_keys, numeric_measures
from sluice.operators.chain import apply_steps
from sluice.operators.transforms import migration_columns
from sluice.plans.lineage import RunMetrics, run_with_metrics
from sluice.session import scratch_path
from sluice.sinks.merge import read_target, republish, rows_in_partitions
from sluice.sinks.writer import WriteResult, write_table
from sluice.sources.files import read_table

# ---------------------------------------------------------------- F4 schema migration

CHANGES_SCHEMA = "column_name string, source_name string, change string, from_type string, to_type string, lost_values bigint, null_values bigint"


class MigrationError(RuntimeError):
    def __init__(self, reason: str, changes: list[Row]):
        self.changes = changes
        super().__init__(f"schema migration refused: {reason}")


@dataclass(frozen=True)
class MigrationSpec:
    source_path: str
    target_path: str
    target_schema: Any  # StructType or DDL; NOT NULL columns must end up without NULLs
    source_format: str = "parquet"
    source_schema: Any = None
    source_options: Mapping[str, str] | None = None
    merge_schema: bool = False
    target_format: str = "parquet"
    target_options: Mapping[str, str] | None = None
    renames: Mapping[str, str] = field(default_factory=dict)  # old -> new
    defaults: Mapping[str, Any] = field(default_factory=dict)
    drops: tuple[str, ...] | None = None  # source columns that may go; None: any
    partition_cols: tuple[str, ...] = ()
    on_loss: str = "block"  # 'block' refuses lossy casts, 'report' only counts them
    exact_counts: bool = False

    def __post_init__(self):
        if self.on_loss not in ("block", "report"):
            raise ValueError("on_loss must be 'block' or 'report'")
        if self.source_path.rstrip("/") == self.target_path.rstrip("/"):
            raise ValueError("a migration writes a new version; it must not overwrite the path it reads")


@dataclass(frozen=True)
class MigrationResult:
    metrics: RunMetrics
    changes: list[Row]


def target_struct(schema: T.StructType | str) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def migration_changes(df: DataFrame, target: T.StructType | str, renames: Mapping[str, str] | None = None, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """One row per column of either schema: kept, renamed, cast, added or dropped; the values its cast loses and the NULLs it
    will hold. One aggregate over the source."""
    target, renames = target_struct(target), dict(renames or {})
    source_of = {new: old for old, new in renames.items()}
    rows: list[tuple] = []
    aggs = []
    for i, (f, c) in enumerate(zip(target.fields, migration_columns(df, target, renames, defaults), strict=True)):
        src = source_of.get(f.name, f.name)
        there = src in df.columns
        kind = df.schema[src].dataType if there else None
        change = "added" if not there else "cast" if kind != f.dataType else "renamed" if src != f.name else "kept"
        rows.append((f.name, src if there else None, change, kind.simpleString() if there else None, f.dataType.simpleString()))
        lost = F.count_if(named(src).isNotNull() & c.isNull()) if change == "cast" else F.lit(0).cast("bigint")
        aggs += [lost.alias(f"_l{i}"), F.count_if(c.isNull()).alias(f"_n{i}")]
    used = {r[1] for r in rows}
    gone = [(None, f.name, "dropped", f.dataType.simpleString(), None) for f in df.schema.fields if f.name not in used]
    text = lambda v: F.lit(v).cast("string")
    names = [x.split()[0] for x in CHANGES_SCHEMA.split(", ")]
    make = lambda r, lost, nulls: F.struct(*[text(v).alias(n) for v, n in zip(r, names, strict=False)], lost.alias("lost_values"), nulls.alias("null_values"))
    none = F.lit(None).cast("bigint")
    cells = [make(r, F.col(f"_l{i}"), F.col(f"_n{i}")) for i, r in enumerate(rows)] + [make(r, none, none) for r in gone]
    return df.agg(*aggs).select(F.inline(F.array(*cells)))


def run_migration(spark: SparkSession, spec: MigrationSpec) -> MigrationResult:
    """count what the migration would lose, refuse or report it, then write the new version. Raises ``MigrationError`` before
    anything is written for undeclared drops, for lossy casts (``on_loss="block"``) and for NULLs in a NOT NULL column."""
    src = read_table(spark, spec.source_path, spec.source_format, schema=spec.source_schema, merge_schema=spec.merge_schema, options=spec.source_options)
    target = target_struct(spec.target_schema)
    require_columns(src, list(spec.renames), "renamed column")
    changes = migration_changes(src, target, spec.renames, spec.defaults).collect()  # one row per column
    if spec.drops is not None:
        extra = sorted(r["source_name"] for r in changes if r["change"] == "dropped" and r["source_name"] not in spec.drops)
        if extra:
            raise MigrationError(f"columns {extra} would be dropped", changes)
    lossy = {r["column_name"]: r["lost_values"] for r in changes if r["lost_values"]}
    if lossy and spec.on_loss == "block":
        raise MigrationError(f"casts would lose values: {lossy}", changes)
    required = {f.name for f in target.fields if not f.nullable}
    missing = {r["column_name"]: r["null_values"] for r in changes if r["null_values"] and r["column_name"] in required}
    if missing:
        raise MigrationError(f"NOT NULL columns would hold NULLs: {missing}", changes)
    metrics = run_with_metrics(
        src, lambda df: df.select(*migration_columns(df, target, spec.renames, spec.defaults)), spec.target_path, exact_source_count=spec.exact_counts,
        format=spec.target_format, mode="error", partition_cols=list(spec.partition_cols), options=spec.target_options,
    )
    return MigrationResult(metrics=metrics, changes=changes)


# ---------------------------------------------------------------- F5 aggregation

STORED = ("count", "sum", "min", "max")


@dataclass(frozen=True)
class AggregationSpec:
    source_path: str
    target_path: str
    keys: tuple[str, ...]
    measures: tuple[str, ...] = ()  # default: every numeric column that is no key
    partition_cols: tuple[str, ...] = ()  # a subset of the keys
    mode: str = "overwrite"  # or 'add'
    batch_id: str | None = None  # names the batch of an 'add'
    source_format: str = "parquet"
    source_schema: Any = None
    source_options: Mapping[str, str] | None = None
    target_format: str = "parquet"
    steps: tuple[Any, ...] = ()

    def __post_init__(self):
        for name in ("keys", "measures", "partition_cols", "steps"):
            object.__setattr__(self, name, tuple(getattr(self, name)))
        if self.mode not in ("overwrite", "add"):
            raise ValueError("mode must be 'overwrite' or 'add'")
        if not set(self.partition_cols) <= set(self.keys):
            raise ValueError("partition columns must be among the keys: a group belongs to one partition")
        if self.mode == "add" and not (self.batch_id and self.partition_cols):
            raise ValueError("mode 'add' needs a batch_id and partition columns (only touched partitions are rewritten)")


@dataclass(frozen=True)
class AggregationResult:
    write: WriteResult
    added: bool  # False: this batch was in the table already
    staging_path: str | None = None


def stored_aggregates(df: DataFrame, keys: Sequence[str], measures: Sequence[str] | None = None) -> DataFrame:
    """``row_count`` and, per measure, what combines: ``count_``, ``sum_``, ``min_``, ``max_``."""
    return aggregate_by_keys(df, keys, measures or None, STORED)


def combine_aggregates(frames: Sequence[DataFrame], keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Stored aggregates of several parts of a table -> those of the whole. Types are those of the first frame."""
    first = frames[0]
    names = ["row_count", *[f"{s}_{m}" for m in measures for s in STORED]]
    every = first.select(*[named(c) for c in [*keys, *names]])
    for f in frames[1:]:
        every = every.unionByName(f.select(*[named(c).cast(first.schema[c].dataType).alias(c) for c in [*keys, *names]]))
    how = {"row_count": F.sum, **{f"{s}_{m}": F.min if s == "min" else F.max if s == "max" else F.sum for m in measures for s in STORED}}
    return every.groupBy(*[named(k) for k in keys]).agg(*[how[n](named(n)).cast(first.schema[n].dataType).alias(n) for n in names])


def with_averages(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """``avg_`` of each measure; NULL for a group without values."""
    return df.withColumns({f"avg_{m}": F.when(named(f"count_{m}") > 0, named(f"sum_{m}").cast("double") / named(f"count_{m}")) for m in measures})


def run_aggregation(spark: SparkSession, spec: AggregationSpec) -> AggregationResult:
    """read -> steps -> aggregates -> table (computed anew, or a batch added to it)."""
    src = read_table(spark, spec.source_path, spec.source_format, schema=spec.source_schema, options=spec.source_options)
    df = apply_steps(src, spec.steps)
    measures = list(spec.measures) or numeric_measures(df, spec.keys)
    batch, parts = stored_aggregates(df, spec.keys, measures), as_list(list(spec.partition_cols))
    if spec.mode == "overwrite":
        result = write_table(with_averages(batch, measures), spec.target_path, format=spec.target_format, mode="overwrite", partition_cols=parts)
        return AggregationResult(write=result, added=True)

    root, schema = f"{spec.target_path.rstrip('/')}/_sluice_batches", with_averages(batch, measures).schema
    ended = lambda name: f"{root}/done/{hashlib.md5(name.encode()).hexdigest()}"

    def publish(name: str, staging: str) -> AggregationResult:
        result = republish(spark, staging, spec.target_path, parts, format=spec.target_format, schema=schema)
        _note(spark, ended(name), name, staging)
        return AggregationResult(write=result, added=True, staging_path=staging)

    if _exists(spark, f"{root}/open/_SUCCESS"):  # a run that did not end: its staged result stands, and goes first
        last = spark.read.parquet(f"{root}/open").first()
        if not _exists(spark, f"{ended(last['batch_id'])}/_SUCCESS"):
            finished = publish(last["batch_id"], last["staging_path"])
            if last["batch_id"] == spec.batch_id:
                return finished
    if _exists(spark, f"{ended(spec.batch_id)}/_SUCCESS"):
        return AggregationResult(write=WriteResult(path=spec.target_path, format=spec.target_format, mode="overwrite", partition_cols=tuple(parts), rows_written=0), added=False)
    staging = _prepare(spark, spec, batch, parts, measures, schema)
    _note(spark, f"{root}/open", spec.batch_id, staging)
    return publish(spec.batch_id, staging)


def _prepare(spark: SparkSession, spec: AggregationSpec, batch: DataFrame, parts: Sequence[str], measures: Sequence[str], schema: T.StructType) -> str:
    """Stage the new rows of the partitions that the batch touches."""
    kept = scratch_path(spark, "aggregate-batch")
    write_table(batch, kept, mode="error")
    added = spark.read.schema(batch.schema).parquet(kept)
    frames = [added]
    if _has_data(spark, spec.target_path):
        target = read_target(spark, spec.target_path, spec.target_format, with_averages(batch, measures), parts, schema)
        touched = rows_in_partitions(target, added.select(*[named(p) for p in parts]).distinct(), parts)
        frames += [] if touched is None else [touched]
    staging = scratch_path(spark, "aggregate-stage")
    write_table(with_averages(combine_aggregates(frames, spec.keys, measures), measures), staging, format=spec.target_format, mode="error", partition_cols=parts)
    return staging


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _has_data(spark: SparkSession, path: str) -> bool:
    """True if the table's folder holds anything but hidden entries."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and any(not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(p))


def _note(spark: SparkSession, path: str, batch_id: str, staging: str) -> None:
    spark.createDataFrame([(batch_id, staging)], "batch_id string, staging_path string").coalesce(1).write.mode("overwrite").parquet(path)
