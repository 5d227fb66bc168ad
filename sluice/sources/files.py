"""Table scans through ``spark.read``.

Options follow the original tool (CSV: header + type inference; columnar formats:
``mergeSchema``), but an explicit schema is preferred and skips the inference pass.
Remote URIs (``s3a://``, ``gs://``, ``abfs://``, ``hdfs://``) go straight to Hadoop.
Filters and projections applied to the returned frame are pushed into the scan by Catalyst.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions import named
from sluice.functions.io import READ_OPTIONS

CORRUPT = "_corrupt_record"
FILE_FORMATS = ("csv", "parquet", "orc", "json", "delta", "avro", "text")


class CorruptInputError(ValueError):
    pass


def read_table(
    spark: SparkSession,
    path: str | list[str],
    format: str = "parquet",
    schema: T.StructType | str | None = None,
    merge_schema: bool = False,
    options: Mapping[str, str] | None = None,
    with_source_file: bool = False,
    sampling_ratio: float | None = None,
    keep_corrupt: bool = False,
) -> DataFrame:
    """Read a table.

    ``csv``: ``header=true``; types are inferred only when no ``schema`` is given.
    ``csv`` / ``json`` are parsed in FAILFAST mode: a malformed record raises instead of turning into NULLs.
    ``keep_corrupt`` (needs a ``schema``): malformed records are kept instead, whole, in the extra column
    ``_corrupt_record`` (NULL for good records); see ``split_corrupt``.
    ``parquet`` / ``orc``: ``mergeSchema`` only when asked for: it reads every file footer,
    a full extra pass over a large table.
    ``with_source_file``: add ``_source_file`` from the hidden ``_metadata`` column at the scan
    (needed for file lineage; it must be taken before any shuffle).
    ``sampling_ratio``: for CSV / JSON without a schema, infer types from this fraction of the
    rows instead of a full extra pass over the input.
    """
    fmt = format.lower()
    if fmt not in FILE_FORMATS:
        raise ValueError(f"unknown file format {format!r}; known: {FILE_FORMATS}; jdbc and kafka have their own readers")
    opts: dict[str, str] = dict(READ_OPTIONS.get(fmt, {}))
    if fmt == "csv" and schema is None:
        opts["inferSchema"] = "true"
    elif fmt in ("parquet", "orc"):
        opts["mergeSchema"] = "true" if merge_schema else "false"
    if sampling_ratio is not None and schema is None and fmt in ("csv", "json"):
        opts["samplingRatio"] = str(sampling_ratio)
    if keep_corrupt:
        if fmt not in ("csv", "json") or schema is None:
            raise ValueError("keep_corrupt needs a csv or json source and an explicit schema")
        schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        opts.update(mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
    opts.update(dict(options or {}))
    reader = spark.read.format(fmt).options(**opts)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    if CORRUPT in df.columns and not keep_corrupt:
        raise CorruptInputError(f"{path}: input is not valid {fmt}; rows went to {CORRUPT}")
    if with_source_file:
        df = df.withColumn("_source_file", F.col("_metadata.file_path"))
    return df


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows without the corrupt column, malformed records as the one column ``_corrupt_record``)."""
    # The text of all columns: a record is judged by the columns that are parsed, so none may be pruned.
    parsed = F.length(F.to_json(F.struct(*[named(c) for c in df.columns if c != CORRUPT]))) >= 0
    bad = F.col(CORRUPT).isNotNull()
    return df.where(parsed & ~bad).drop(CORRUPT), df.where(parsed & bad).select(CORRUPT)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    lower_bound: int | None = None,
    upper_bound: int | None = None,
    num_partitions: int | None = None,
    properties: Mapping[str, str] | None = None,
    predicates: list[str] | None = None,
    small: bool = False,
) -> DataFrame:
    """Parallel JDBC scan, by ranges of a numeric / date column or by one task per predicate.
    With neither, one task would read the whole table: refused unless the caller says it is ``small``."""
    if predicates is not None:
        return spark.read.jdbc(url, table, predicates=predicates, properties=dict(properties or {}))
    if partition_column is not None and None in (lower_bound, upper_bound, num_partitions):
        raise ValueError("partition_column needs lower_bound, upper_bound and num_partitions")
    if partition_column is None:
        if not small:
            raise ValueError("read_jdbc needs partition_column with bounds, or predicates, or small=True")
        return spark.read.jdbc(url, table, properties=dict(properties or {}))
    return spark.read.jdbc(
        url,
        table,
        column=partition_column,
        lowerBound=lower_bound,
        upperBound=upper_bound,
        numPartitions=num_partitions,
        properties=dict(properties or {}),
    )


def read_delta(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Delta scan; needs the Delta connector on the classpath (not bundled here)."""
    reader = spark.read.format("delta")
    if version is not None:
        reader = reader.option("versionAsOf", str(version))
    return reader.load(path)
