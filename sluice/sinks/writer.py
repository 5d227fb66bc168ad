"""K1, K2, K4, K6: batch writes with in-job metrics.

* Row counts come from ``DataFrame.observe`` in the same job as the write (the original
  tool ran an extra ``count()`` first, executing the whole plan twice).
* Partition columns are checked before anything is written.
* With partition columns, the frame gets a ``rebalance`` hint on them: one shuffle that
  puts each output partition in few tasks (bounded file count) while AQE splits a skewed
  output partition into several tasks and merges tiny ones.
* ``overwrite_partitions=True`` sets ``partitionOverwriteMode=dynamic`` as a writer option
  (not session-wide): an overwrite replaces only the partitions present in the frame.
* There is no silent format fallback: a failing write raises.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sluice.functions import as_list, named, require_columns
from sluice.functions.io import WRITE_OPTIONS
from sluice.sources.files import read_table

FORMATS = ("parquet", "orc", "json", "csv", "delta", "avro", "text")
MODES = ("append", "overwrite", "error", "errorifexists", "ignore")


@dataclass(frozen=True)
class WriteResult:
    path: str
    format: str
    mode: str
    partition_cols: tuple[str, ...]
    rows_written: int
    staging_path: str | None = None  # staged copy a failed publish can be replayed from
    rows_inserted: int | None = None  # upserts: keys new to the target
    rows_updated: int | None = None  # upserts: keys that were there
    files_written: int | None = None  # with measure_files: data files at the path after the write
    bytes_written: int | None = None


def write_table(
    df: DataFrame,
    path: str,
    format: str = "parquet",
    mode: str = "append",
    partition_cols: str | Sequence[str] | None = None,
    options: Mapping[str, str] | None = None,
    overwrite_partitions: bool = False,
    rebalance: bool = True,
    max_records_per_file: int | None = None,
    measure_files: bool = False,
) -> WriteResult:
    """Write ``df`` and return what was written; ``rows_written`` is observed in the write job.
    ``measure_files``: also list the path for the files and bytes written (not for a dynamic partition overwrite)."""
    fmt = format.lower()
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {format!r}; known: {FORMATS}")
    if mode not in MODES:
        raise ValueError(f"unknown save mode {mode!r}; for merge / upsert use sluice.sinks.merge_upsert")
    parts = as_list(partition_cols)
    require_columns(df, parts, "partition column")
    if overwrite_partitions and (mode != "overwrite" or not parts):
        raise ValueError("overwrite_partitions needs mode='overwrite' and partition columns")

    obs = Observation("sluice_write")
    out = prepare_write(df, parts, rebalance).observe(obs, F.count(F.lit(1)).alias("rows"))
    opts = {**WRITE_OPTIONS.get(fmt, {}), **dict(options or {})}
    writer = out.write.format(fmt).mode(mode).options(**opts)
    if parts:
        writer = writer.partitionBy(*parts)
    if overwrite_partitions:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", str(max_records_per_file))
    before = stored(df.sparkSession, path) if measure_files else (0, 0)
    writer.save(path)
    files, size = stored(df.sparkSession, path) if measure_files else (None, None)
    if measure_files and mode == "append":
        files, size = files - before[0], size - before[1]
    return WriteResult(path=path, format=fmt, mode=mode, partition_cols=tuple(parts), rows_written=observed(obs), files_written=files, bytes_written=size)


def observed(obs: Observation, missing: int | None = 0) -> int | None:
    """The observed row count; ``missing`` when the plan folded to an empty relation, so that nothing was observed."""
    try:
        return int(obs.get.get("rows", 0))
    except Py4JJavaError as e:  # the row of an observation that never ran has no schema to convert by
        if "toPyRow" in str(e):
            return missing
        raise


def stored(spark, path: str) -> tuple[int, int]:
    """Data files below a path and their bytes, from the file system's listing."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files = size = 0
    if fs.exists(folder):
        each = fs.listFiles(folder, True)
        while each.hasNext():
            f = each.next()
            if not f.getPath().getName().startswith(("_", ".")):
                files, size = files + 1, size + f.getLen()
    return files, size


def prepare_write(df: DataFrame, partition_cols: Sequence[str], rebalance: bool = True) -> DataFrame:
    """The frame a partitioned write actually writes: a ``rebalance`` on the partition columns."""
    parts = as_list(partition_cols)
    return df.hint("rebalance", *parts) if parts and rebalance else df


def partition_manifest(df: DataFrame, partition_cols: str | Sequence[str]) -> DataFrame:
    """Rows per output partition (K4), as a plain aggregate over the frame to be written."""
    parts = as_list(partition_cols)
    require_columns(df, parts, "partition column")
    return df.groupBy(*parts).agg(F.count(F.lit(1)).alias("rows"))


def written_partitions(spark, path: str, format: str = "parquet") -> DataFrame:
    """Rows and files per output partition directory, read from what is on storage."""
    df = read_table(spark, path, format)
    per_file = df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("rows"))
    # the directory of each file: everything before the last '/', derived once per file
    file_dir = F.expr("substring(file, 1, length(file) - length(substring_index(file, '/', -1)) - 1)")
    return per_file.groupBy(file_dir.alias("partition_dir")).agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("files"))


def write_bucketed_table(
    df: DataFrame,
    table: str,
    keys: str | Sequence[str],
    buckets: int,
    mode: str = "overwrite",
    format: str = "parquet",
    partition_cols: str | Sequence[str] | None = None,
) -> WriteResult:
    """Save ``df`` as a catalog table bucketed (and sorted) by ``keys``.

    A later join or merge on the same keys reads it already hash-partitioned: Spark shuffles
    only the other side (to the bucket count), never this table. Worth it for a large table
    that is merged into or joined on its key again and again.
    """
    keys = as_list(keys)
    parts = as_list(partition_cols)
    require_columns(df, keys + parts, "bucket / partition column")
    obs = Observation("sluice_bucketed_write")
    # one task per bucket: otherwise each of the input's tasks writes a file for every bucket
    dealt = df.repartition(buckets, *[named(k) for k in keys])
    writer = dealt.observe(obs, F.count(F.lit(1)).alias("rows")).write.format(format).mode(mode).bucketBy(buckets, *keys).sortBy(*keys)
    if parts:
        writer = writer.partitionBy(*parts)
    writer.saveAsTable(table)
    return WriteResult(path=table, format=format, mode=mode, partition_cols=tuple(parts), rows_written=observed(obs))
