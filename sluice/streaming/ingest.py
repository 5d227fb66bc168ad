"""Structured Streaming ingest.

source (Kafka, or files arriving in a folder) -> stateless steps (fill, audit, derive)
-> optional dedupe within a watermark -> file sink partitioned by hour (or day), with the
checkpoint under the shared folder so a restarted query resumes exactly where it stopped.

Small-file control: each micro-batch gets a ``rebalance`` hint on the partition column(s).
AQE runs inside stateless micro-batches, so a batch writes about one file per partition value
(instead of one per task and value), while a hot hour is still split over several tasks by
AQE's skew handling for rebalance shuffles.
"""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions import as_list, day_bucket, event_time, hour_bucket, named, require_columns
from sluice.functions.io import READ_OPTIONS
from sluice.operators.chain import apply_steps, step_names
from sluice.sources.files import CORRUPT

EVENT_TIME = "_event_time"
NO_KEY = "_no_key"
# Progress entries kept for a drained query (Spark keeps 100 by default); they are also collected while it runs.
KEPT_PROGRESS = 10_000
STATEFUL_STEPS = {"deduplicate"}


# ------------------------------------------------------------------ sources


def read_file_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    format: str = "parquet",
    max_files_per_trigger: int | None = None,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Files arriving in ``path`` as a stream (oldest first). A schema is required."""
    reader = spark.readStream.format(format).schema(schema).options(**dict(options or {}))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(path)


def read_kafka_stream(
    spark: SparkSession,
    bootstrap_servers: str,
    topic: str,
    value_schema: T.StructType | str,
    starting_offsets: str = "earliest",
    max_offsets_per_trigger: int | None = None,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Kafka topic -> columns of the JSON value, plus the record timestamp as ``_kafka_ts``.

    Needs the ``spark-sql-kafka`` connector on the classpath (not bundled here). Key, partition and offset are
    kept, and malformed messages too, see ``parse_json_messages``.
    ``max_offsets_per_trigger`` bounds each micro-batch, which also bounds file sizes and skew.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", bootstrap_servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting_offsets)
        .options(**dict(options or {}))
    )
    if max_offsets_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", str(max_offsets_per_trigger))
    raw = reader.load()
    return parse_json_messages(raw, value_schema)


def parse_json_messages(df: DataFrame, value_schema: T.StructType | str) -> DataFrame:
    """Columns of the JSON ``value`` (binary or text) of any frame, batch or stream.

    A message that is not JSON of the schema keeps its whole text in ``_corrupt_record`` (NULL for good ones)
    and has NULL in the value's columns. The record's ``key``, ``partition``, ``offset`` and ``timestamp``,
    where there are any, come along as ``_kafka_key``, ``_kafka_partition``, ``_kafka_offset`` and ``_kafka_ts``.
    """
    schema = T.StructType.fromDDL(value_schema) if isinstance(value_schema, str) else value_schema
    schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json(F.col("value").cast("string"), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, **_json_times()})
    about = {"key": "_kafka_key", "partition": "_kafka_partition", "offset": "_kafka_offset", "timestamp": "_kafka_ts"}
    kept = [named(c).alias(n) for c, n in about.items() if c in df.columns]
    return df.select(parsed.alias("_v"), *kept).select("_v.*", *[n for c, n in about.items() if c in df.columns])


def _json_times() -> dict[str, str]:
    return {k: v for k, v in READ_OPTIONS["json"].items() if k.endswith("Format")}


# ------------------------------------------------------------------ operators


def with_time_partition(df: DataFrame, ts_col: str, grain: str = "hour", name: str | None = None) -> DataFrame:
    """Add the partition column (``hour``: ``yyyy-MM-dd-HH`` text; ``day``: ``yyyy-MM-dd``)."""
    require_columns(df, [ts_col], "event time column")
    if grain == "hour":
        return df.withColumn(name or "hour", hour_bucket(ts_col))
    if grain == "day":
        return df.withColumn(name or "day", day_bucket(ts_col))
    raise ValueError("grain must be 'hour' or 'day'")


def dedupe_within_watermark(df: DataFrame, keys: str | Sequence[str], ts_col: str, delay: str) -> DataFrame:
    """Drop rows whose key was already seen within ``delay`` of event time.

    State per key lives until the watermark passes it; rows older than the watermark are
    dropped as late (count reported as ``rows_dropped_by_watermark``). TIMESTAMP_NTZ event
    times are cast to TIMESTAMP in the session zone first (watermarks reject NTZ). Rows with a NULL in the
    key (malformed messages) are no copies of each other: all of them stay, unless late.
    """
    keys = as_list(keys)
    require_columns(df, keys + [ts_col], "dedupe column")
    no_key = reduce(Column.__or__, [named(k).isNull() for k in keys])
    timed = df.withColumns({EVENT_TIME: event_time(df, ts_col), NO_KEY: F.when(no_key, F.uuid())})
    return timed.withWatermark(EVENT_TIME, delay).dropDuplicatesWithinWatermark([*keys, NO_KEY]).drop(EVENT_TIME, NO_KEY)


def stream_steps(df: DataFrame, steps: Sequence[Any]) -> DataFrame:
    """The batch steps on a stream; only stateless ones are allowed without a watermark."""
    stateful = STATEFUL_STEPS.intersection(step_names(steps))
    if stateful:
        raise ValueError(f"steps {sorted(stateful)} need state; use dedupe_within_watermark on a stream")
    return apply_steps(df, steps)


# ------------------------------------------------------------------ sink


@dataclass(frozen=True)
class StreamResult:
    path: str
    checkpoint: str
    batches: int
    input_rows: int
    rows_dropped_by_watermark: int


def start_stream_files(
    df: DataFrame,
    path: str,
    checkpoint: str,
    partition_cols: str | Sequence[str] = ("hour",),
    format: str = "parquet",
    available_now: bool = False,
    processing_time: str | None = None,
    query_name: str | None = None,
    spread_by: Sequence[str] = (),
    spread: int = 8,
):
    """Start the partitioned file sink and return the running ``StreamingQuery``.

    The file sink's ``_spark_metadata`` log makes the output exactly-once: a batch redone
    after a failure replaces, not duplicates, its files for readers that go through Spark.
    After a stateful step AQE does not run, so a rebalance would send a partition value to one task:
    ``spread_by`` (columns, such as the dedupe keys) deals it to up to ``spread`` tasks and files instead, and the
    query starts with ``state_partitions``.
    """
    parts = as_list(partition_cols)
    require_columns(df, parts, "partition column")
    if parts and spread_by:
        bucket = F.pmod(F.xxhash64(*[named(c) for c in spread_by]), F.lit(spread))
        out = df.repartition(*[named(p) for p in parts], bucket)
    else:
        out = df.hint("rebalance", *parts) if parts else df
    writer = out.writeStream.format(format).outputMode("append").option("checkpointLocation", checkpoint).option("path", path)
    if parts:
        writer = writer.partitionBy(*parts)
    if query_name:
        writer = writer.queryName(query_name)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    spark, key = df.sparkSession, "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    bound = state_partitions(spark) if spread_by else int(before)
    if bound >= int(before):
        return writer.start()
    spark.conf.set(key, str(bound))  # a query keeps the number it starts with, or that of its checkpoint
    try:
        return writer.start()
    finally:
        spark.conf.set(key, before)


def state_partitions(spark: SparkSession) -> int:
    """Partitions of a stateful query: the session's shuffle partitions, but no more than the cores.

    A batch commits one store, and so some small files, per partition, whatever it holds: partitions beyond the cores
    cost each batch time and give no more parallelism, and a store streams its rows, so that larger partitions need
    no more memory in all. With dynamic allocation the cores at the start say little: the session's number stays.
    """
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        return wanted
    return min(wanted, max(1, spark.sparkContext.defaultParallelism))


def write_stream_files(
    df: DataFrame,
    path: str,
    checkpoint: str,
    partition_cols: str | Sequence[str] = ("hour",),
    format: str = "parquet",
    timeout_s: float | None = None,
    spread_by: Sequence[str] = (),
    spread: int = 8,
) -> StreamResult:
    """Drain everything available now into the sink (``availableNow``), wait, and report."""
    spark, key = df.sparkSession, "spark.sql.streaming.numRecentProgressUpdates"
    before = spark.conf.get(key)
    spark.conf.set(key, str(max(int(before), KEPT_PROGRESS)))  # Spark reads it at each batch, until the query ends
    progress: dict[int, dict] = {}
    end = time.monotonic() + timeout_s if timeout_s else None
    query = None
    try:
        query = start_stream_files(df, path, checkpoint, partition_cols, format, available_now=True, spread_by=spread_by, spread=spread)
        while not query.awaitTermination(5 if end is None else max(0.1, min(5, end - time.monotonic()))):
            progress.update(_progress(query))
            if end is not None and time.monotonic() >= end:
                raise TimeoutError(f"stream to {path} did not drain within {timeout_s}s")
        progress.update(_progress(query))
    finally:
        if query is not None and query.isActive:
            query.stop()
        spark.conf.set(key, before)
    if query.exception():
        raise RuntimeError(f"stream to {path} failed: {query.exception()}")
    return stream_result(progress.values(), path, checkpoint)


def _progress(query) -> dict[int, dict]:
    """The query's recent progress by batch (a batch without data may report more than once: the largest counts)."""
    found: dict[int, dict] = {}
    for p in map(_as_dict, query.recentProgress):
        old = found.get(p["batchId"])
        if old is None or p.get("numInputRows", 0) >= old.get("numInputRows", 0):
            found[p["batchId"]] = p
    return found


def stream_result(progress, path: str, checkpoint: str) -> StreamResult:
    """Batches, input rows and rows dropped by the watermark, over one progress entry per batch, or over what a
    query still keeps (the last ``spark.sql.streaming.numRecentProgressUpdates`` batches)."""
    progress = list(_progress(progress).values() if hasattr(progress, "recentProgress") else progress)
    return StreamResult(
        path=path,
        checkpoint=checkpoint,
        batches=sum(1 for p in progress if p.get("numInputRows", 0) > 0),
        input_rows=sum(p.get("numInputRows", 0) for p in progress),
        rows_dropped_by_watermark=sum(op.get("numRowsDroppedByWatermark", 0) for p in progress for op in p.get("stateOperators") or []),
    )


def _as_dict(progress) -> dict:
    """Progress objects (PySpark 4) and plain dicts (older) alike."""
    if isinstance(progress, dict):
        return progress
    import json

    return json.loads(progress.json)


# ------------------------------------------------------------------ F2


@dataclass(frozen=True)
class StreamSpec:
    target_path: str
    checkpoint: str
    ts_col: str
    grain: str = "hour"
    steps: tuple[Any, ...] = ()
    dedupe_keys: tuple[str, ...] = ()
    dedupe_delay: str = "1 hour"
    dedupe_spread: int = 8  # tasks and files per partition value and batch after the dedupe


def ingest_plan(stream: DataFrame, spec: StreamSpec) -> DataFrame:
    """F2 as a streaming plan: stateless steps -> optional watermark dedupe -> time partition."""
    df = stream_steps(stream, spec.steps)
    if spec.dedupe_keys:
        df = dedupe_within_watermark(df, list(spec.dedupe_keys), spec.ts_col, spec.dedupe_delay)
    return with_time_partition(df, spec.ts_col, spec.grain)


def run_stream_ingest(stream: DataFrame, spec: StreamSpec) -> StreamResult:
    """F2, drained: process everything available now, then stop (a scheduled / catch-up run)."""
    return write_stream_files(ingest_plan(stream, spec), spec.target_path, spec.checkpoint, partition_cols=[spec.grain], spread_by=spec.dedupe_keys, spread=spec.dedupe_spread)


def start_stream_ingest(stream: DataFrame, spec: StreamSpec, processing_time: str = "1 minute", query_name: str | None = None):
    """F2, continuous: start the query with a processing-time trigger and return it.

    At scale, pair it with a bounded source batch (``maxOffsetsPerTrigger`` /
    ``maxFilesPerTrigger``) and, for the dedupe state, the RocksDB state store provider.
    """
    return start_stream_files(
        ingest_plan(stream, spec), spec.target_path, spec.checkpoint, partition_cols=[spec.grain], processing_time=processing_time, query_name=query_name,
        spread_by=spec.dedupe_keys, spread=spec.dedupe_spread,
    )
