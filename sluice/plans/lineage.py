"""R3 row lineage by files, R4 run metrics.

Lineage: the scan adds ``_source_file`` (from the hidden ``_metadata`` column, before any
shuffle); every operator here keeps it as an ordinary column (dedupe carries the file of
the *surviving* row), and the sink writes it. Edges are then an aggregate over the written
table joined to nothing: ``(source file, target file) -> rows``, reading two columns only.
The original tool returned five constant nodes and four constant edges instead.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sluice.sinks.writer import WriteResult, observed, write_table

SOURCE_FILE = "_source_file"


def _level(path: Column, level: str) -> Column:
    if level == "file":
        return path
    if level == "directory":
        # last directory name, e.g. ``o_year=1996`` for a hive-style partition
        return F.substring_index(F.substring_index(path, "/", -2), "/", 1)
    raise ValueError(f"level must be 'file' or 'directory', not {level!r}")


def lineage_edges(written: DataFrame, level: str = "file", source_col: str = SOURCE_FILE) -> DataFrame:
    """Edges ``source, target, rows`` from a table read back from the sink.

    ``written`` must be a file scan of the sink output (so ``_metadata`` exists) that holds
    the ``_source_file`` column written with the data.
    """
    if level not in ("file", "directory"):
        raise ValueError(f"level must be 'file' or 'directory', not {level!r}")
    if source_col not in written.columns:
        raise ValueError(f"{source_col!r} is not in the written table; read the source with with_source_file=True")
    # Count per (source file, target file) first: a handful of groups per task, so the
    # string work of the directory level runs on those groups, not on every row.
    per_file = written.groupBy(F.col(source_col).alias("source"), F.col("_metadata.file_path").alias("target")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    if level == "file":
        return per_file
    return (
        per_file.select(_level(F.col("source"), level).alias("source"), _level(F.col("target"), level).alias("target"), "rows")
        .groupBy("source", "target")
        .agg(F.sum("rows").alias("rows"))
    )


def lineage_nodes(edges: DataFrame) -> DataFrame:
    """Nodes ``node, kind ('source' / 'sink'), rows`` as the distinct ends of the edges.

    One pass: every edge emits its two ends, then one aggregate (a union of two group-bys
    would compute the edges twice)."""
    ends = edges.select(
        F.inline(
            F.array(
                F.struct(F.col("source").alias("node"), F.lit("source").alias("kind"), F.col("rows").alias("rows")),
                F.struct(F.col("target").alias("node"), F.lit("sink").alias("kind"), F.col("rows").alias("rows")),
            )
        )
    )
    return ends.groupBy("node", "kind").agg(F.sum("rows").alias("rows"))


@dataclass(frozen=True)
class RunMetrics:
    rows_in: int
    rows_out: int
    write: WriteResult

    @property
    def rows_removed(self) -> int:
        return self.rows_in - self.rows_out


def run_with_metrics(
    source: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    path: str,
    exact_source_count: bool = False,
    **write_args,
) -> RunMetrics:
    """Observe rows at the source and at the sink in the one write job.

    The sink count is observed in the result stage and is exact. The source count sits
    before any shuffle of the steps; if an executor loss makes Spark re-run that stage, its
    observation can count the re-run. ``exact_source_count=True`` counts the source in its
    own job instead (for Parquet / ORC that reads only file footers)."""
    if exact_source_count:
        result = write_table(transform(source), path, **write_args)
        return RunMetrics(rows_in=source.count(), rows_out=result.rows_written, write=result)
    obs_in = Observation("sluice_rows_in")
    observed = source.observe(obs_in, F.count(F.lit(1)).alias("rows"))
    result = write_table(transform(observed), path, **write_args)
    return RunMetrics(rows_in=observed_rows(obs_in, source), rows_out=result.rows_written, write=result)


def observed_rows(obs: Observation, source: DataFrame) -> int:
    """The observed row count. When the optimizer removed the observed node (the steps
    folded to an empty result, so the source was never scanned), count the source instead."""
    rows = observed(obs, missing=None)
    return rows if rows is not None else source.count()


def metrics_frame(spark, m: RunMetrics) -> DataFrame:
    """The three observed numbers as a one-row frame (for reports / sinks)."""
    return spark.createDataFrame(
        [(m.rows_in, m.rows_out, m.rows_removed)],
        "rows_in bigint, rows_out bigint, rows_removed bigint",
    )
