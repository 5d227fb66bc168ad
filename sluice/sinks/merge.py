"""K3: keyed merge / upsert as a DataFrame plan.

result = (target rows whose key is not in the updates) UNION (updates, one row per key).

* The update batch is first deduplicated per key with the ordered survivor of
  :func:`sluice.operators.dedupe` (``order_by`` + ``keep="last"``: the newest version wins),
  a map-side-combined aggregate. Flows that write stage this batch once in the shared folder and
  derive everything else from that copy.
* The anti join is planned by Catalyst: sort-merge on the keys, or a broadcast hash join
  of a side whose size Spark knows to be below its threshold. A skewed target key is split by AQE's skew-join handling.
* NULL keys never match (SQL ``MERGE`` semantics): such target rows stay and such
  update rows are all inserted, each of them.
* Replacement is per key: if the target holds several rows for an updated key, all of them
  are replaced by the one winning update row (an upsert on a key, not SQL ``MERGE``'s
  row-by-row update).

Never write the result over the path the target was read from: Spark would delete the
input files before reading them. :func:`merge_into_path` writes to a new path.
Staged copies under the shared folder (``merge-stage``, ``merge-updates``) are full copies of what a merge
rewrites; they are kept so that a failed publish can be replayed, and expire with that folder's own retention.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions import as_list, named, quoted, require_columns
from sluice.operators.dedupe import dedupe
from sluice.session import scratch_path
from sluice.sinks.writer import WriteResult, write_table
from sluice.sources.files import read_table


def latest_updates(updates: DataFrame, keys: str | Sequence[str], order_by: str | Sequence[str] | None = None) -> DataFrame:
    """One row per key, the last by ``order_by``; rows with a NULL in the key all stay."""
    keys = as_list(keys)
    require_columns(updates, keys, "update key")
    whole = reduce(Column.__and__, [named(k).isNotNull() for k in keys])
    return dedupe(updates.where(whole), keys, order_by=order_by, keep="last").unionByName(updates.where(~whole))


def _renamed(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The columns under private names, so that a join with a frame of the same lineage is unambiguous."""
    names = [f"_sluice_m{i}" for i in range(len(cols))]
    return df.select(*[named(c).alias(n) for c, n in zip(cols, names, strict=True)]), names


def _matching(df: DataFrame, other: DataFrame, cols: Sequence[str], how: str, nulls_match: bool = False) -> DataFrame:
    right, names = _renamed(other, cols)
    pairs = [(df[quoted(c)], right[n]) for c, n in zip(cols, names, strict=True)]
    return df.join(right, reduce(Column.__and__, [a.eqNullSafe(b) if nulls_match else a == b for a, b in pairs]), how)


def merge_upsert(
    target: DataFrame,
    updates: DataFrame,
    keys: str | Sequence[str],
    order_by: str | Sequence[str] | None = None,
    delete_col: str | None = None,
) -> DataFrame:
    """Upsert ``updates`` into ``target`` on ``keys``.

    ``order_by``: columns of ``updates`` deciding which of several updates of one key wins
    (largest wins); without it the tie-break is the largest row, still deterministic.
    ``delete_col``: optional boolean column of ``updates``; a winning update with it true
    deletes the key instead of upserting it.
    Columns of ``updates`` absent from ``target`` are dropped; target columns absent from
    ``updates`` become NULL for updated / inserted rows.
    """
    keys = as_list(keys)
    require_columns(target, keys, "target key")
    if delete_col:
        require_columns(updates, [delete_col], "delete flag")
    return _replace(target, latest_updates(updates, keys, order_by), keys, delete_col)


def _replace(target: DataFrame, latest: DataFrame, keys: Sequence[str], delete_col: str | None = None) -> DataFrame:
    kept = _matching(target, latest, keys, "left_anti")
    if delete_col:
        latest = latest.where(~F.coalesce(named(delete_col), F.lit(False)))
    incoming = latest.select(*[named(c) for c in target.columns if c in latest.columns])
    return kept.unionByName(incoming, allowMissingColumns=True).select(*[named(c) for c in target.columns])


def merge_into_path(
    spark,
    target_path: str,
    updates: DataFrame,
    keys: str | Sequence[str],
    out_path: str,
    format: str = "parquet",
    order_by: str | Sequence[str] | None = None,
    partition_cols: Sequence[str] | None = None,
    delete_col: str | None = None,
) -> WriteResult:
    """Read the target, merge, write the new version to ``out_path`` (must differ)."""
    if out_path.rstrip("/") == target_path.rstrip("/"):
        raise ValueError("merge output must not overwrite the path it reads; write a new version")
    target = read_target(spark, target_path, format, updates, as_list(partition_cols))
    merged = merge_upsert(target, updates, keys, order_by=order_by, delete_col=delete_col)
    return write_table(merged, out_path, format=format, mode="error", partition_cols=partition_cols)


def read_target(spark, path: str, format: str, updates: DataFrame, partition_cols: Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """The target with partition types taken from the updates (or ``schema``), never inferred from the
    directory names: inference would read the text '01' as the number 1 and write it back as another partition."""
    if schema is None:
        found = read_table(spark, path, format).schema
        schema = T.StructType([T.StructField(f.name, updates.schema[f.name].dataType if f.name in partition_cols else f.dataType) for f in found.fields])
    return read_table(spark, path, format, schema=schema)


def merge_partitions(
    spark,
    target_path: str,
    updates: DataFrame,
    keys: str | Sequence[str],
    partition_cols: Sequence[str],
    format: str = "parquet",
    order_by: str | Sequence[str] | None = None,
    keys_may_move: bool = True,
    max_listed_partitions: int = 10_000,
    delete_col: str | None = None,
    target_schema: T.StructType | None = None,
) -> WriteResult:
    """Merge into a partitioned table by rewriting only the partitions the updates touch.

    1. The deduplicated update batch is written once to the shared folder.
    2. Touched partitions = partition values in the updates, plus the partitions that now hold an
       updated key, found from the key and partition columns of the target. ``keys_may_move=False`` skips
       that scan for callers who know that a key never changes its partition.
    3. The target scan is limited to those partitions, NULL partitions included: by an ``IN`` filter that prunes the
       scan when there are at most ``max_listed_partitions`` values (partition values are table
       metadata, not rows), otherwise by a null-safe semi join. Both give the same rows.
    4. The merged partitions are written to a staging folder under the shared checkpoint
       folder, then replace their originals with dynamic partition overwrite; a partition whose rows
       have all moved away (or were deleted) is dropped. If the publish fails it can be re-run from the staged copy;
       untouched partitions are never read or rewritten.
    """
    keys, parts = as_list(keys), as_list(partition_cols)
    require_columns(updates, keys + parts, "update key / partition")
    target = read_target(spark, target_path, format, updates, parts, target_schema)
    require_columns(target, keys + parts, "target key / partition")
    if delete_col:
        require_columns(updates, [delete_col], "delete flag")

    updates_path = scratch_path(spark, "merge-updates")
    applied = write_table(latest_updates(updates, keys, order_by), updates_path, mode="error").rows_written
    latest = spark.read.schema(updates.schema).parquet(updates_path)
    touched = latest.select(*[named(p) for p in parts])
    if keys_may_move:
        touched = touched.unionByName(_matching(target.select(*[named(c) for c in dict.fromkeys(keys + parts)]), latest, keys, "left_semi").select(*[named(p) for p in parts]))
    touched = touched.distinct()

    in_scope = rows_in_partitions(target, touched, parts, max_listed_partitions)
    if in_scope is None:
        return WriteResult(path=target_path, format=format, mode="overwrite", partition_cols=tuple(parts), rows_written=0, rows_inserted=0, rows_updated=0)

    updated = _matching(latest.select(*[named(k) for k in keys]), in_scope, keys, "left_semi").count()
    deleted = latest.where(F.coalesce(named(delete_col), F.lit(False))).count() if delete_col else 0
    merged = _replace(in_scope, latest, keys, delete_col)
    staged = scratch_path(spark, "merge-stage")
    write_table(merged, staged, format=format, mode="error", partition_cols=parts)
    published = read_table(spark, staged, format, schema=target.schema)
    # A partition without rows is not in the staged copy, so that dynamic overwrite leaves its old files.
    emptied = _matching(in_scope, published.select(*[named(p) for p in parts]).distinct(), parts, "left_anti", nulls_match=True)
    folders = [r[0] for r in emptied.select(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("folder")).distinct().collect()]
    result = republish(spark, staged, target_path, parts, format=format, schema=target.schema)
    drop_folders(spark, target_path, folders)
    return dataclasses.replace(result, rows_updated=updated, rows_inserted=max(0, applied - updated - max(0, deleted - updated)))


def rows_in_partitions(target: DataFrame, touched: DataFrame, parts: Sequence[str], max_listed_partitions: int = 10_000) -> DataFrame | None:
    """The rows of ``target`` in the partitions ``touched`` (distinct partition values), NULL partitions included; None if there are
    no values. Up to ``max_listed_partitions`` values prune the scan, more go through a null-safe semi join."""
    listed = touched.limit(max_listed_partitions + 1).collect()
    if not listed:
        return None
    if len(listed) <= max_listed_partitions:
        # One flat IN over struct(partition columns): null-safe (struct comparison treats NULL
        # fields as equal), a hash-set lookup after Catalyst's OptimizeIn, and a partition
        # filter the scan prunes with. (10,000 OR-ed equalities would nest 10,000 deep.)
        values = [F.struct(*[F.lit(row[c]).cast(target.schema[c].dataType).alias(c) for c in parts]) for row in listed]
        return target.where(F.struct(*[named(c) for c in parts]).isin(values))
    return _matching(target, touched, parts, "left_semi", nulls_match=True)


def drop_folders(spark, table_path: str, folders: Sequence[str]) -> None:
    """Remove partition folders below a table's path (those a merge has emptied)."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(table_path)
    fs = root.getFileSystem(conf)
    base = fs.makeQualified(root).toUri().getPath().rstrip("/") + "/"
    for f in folders:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f))
        if not path.toUri().getPath().startswith(base):
            raise ValueError(f"{f} is not a partition of {table_path}")
        fs.delete(path, True)


def republish(spark, staging_path: str, target_path: str, partition_cols: Sequence[str], format: str = "parquet", schema: T.StructType | None = None) -> WriteResult:
    """Replace the target's partitions present in a staged copy (dynamic partition overwrite).

    Idempotent: if a publish failed part-way, call it again with the ``staging_path`` the
    failed call's ``WriteResult`` (or the error) carried, and the table's ``schema`` (without it partition types are
    inferred from directory names)."""
    staged = read_table(spark, staging_path, format, schema=schema)
    if schema is not None:
        staged = staged.select(*[named(f.name) for f in schema.fields])
    result = write_table(staged, target_path, format=format, mode="overwrite", partition_cols=list(partition_cols), overwrite_partitions=True)
    return dataclasses.replace(result, staging_path=staging_path)


def merge_into_table(
    table: str,
    updates: DataFrame,
    keys: str | Sequence[str],
    order_by: str | Sequence[str] | None = None,
    delete_col: str | None = None,
) -> None:
    """Keyed upsert into a catalog table whose format supports row-level ``MERGE`` (Delta,
    Iceberg, ...), through ``DataFrame.mergeInto``. The update batch is deduplicated per key
    first (the format would reject several source rows for one target row). Plain parquet
    tables do not support it; use :func:`merge_partitions` or :func:`merge_into_path`."""
    keys = as_list(keys)
    require_columns(updates, keys, "update key")
    latest = latest_updates(updates, keys, order_by).alias("s")
    on = None
    for k in keys:
        eq = F.col(f"{table}.{quoted(k)}") == F.col(f"s.{quoted(k)}")
        on = eq if on is None else (on & eq)
    merge = latest.mergeInto(table, on)
    if delete_col:
        merge = merge.whenMatched(F.col(f"s.{delete_col}")).delete()
        latest_cols = [c for c in updates.columns if c != delete_col]
        assignments = {c: F.col(f"s.{quoted(c)}") for c in latest_cols}
        merge = merge.whenMatched().update(assignments).whenNotMatched(~F.col(f"s.{delete_col}")).insert(assignments)
    else:
        merge = merge.whenMatched().updateAll().whenNotMatched().insertAll()
    merge.merge()
