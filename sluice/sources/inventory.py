"""Source inventory (file count, bytes, format) as a Spark job.

The original walked the directory on one machine. Here the listing is Spark's
``binaryFile`` source with ``content`` never selected, so only file metadata is read
(the column is pruned from the scan); listing itself is parallelised by Spark for large
directory trees. Files whose names start with ``_`` or ``.`` (``_SUCCESS``, checksums,
``_delta_log``) are skipped by the file index, as for any Spark read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators.layout import partitions_for_bytes

# The format names recognised from a file extension.
_EXT = r"(?i)\.(parquet|orc|json|csv|avro|txt)(\.[A-Za-z0-9]+)?$"


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, modificationTime, format`` for every data file below ``path``.

    The data files of a Delta table root (one holding ``_delta_log/``) are labelled ``delta``.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "length", "modificationTime")
    )
    fmt = file_format(F.col("path"))
    if is_delta_table(spark, path):
        fmt = F.when(fmt == "parquet", F.lit("delta")).otherwise(fmt)
    return files.withColumn("format", fmt)


def is_delta_table(spark: SparkSession, path: str) -> bool:
    """True when ``path`` holds a ``_delta_log`` folder (hidden from ordinary listings)."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_delta_log")
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def file_format(path: Column) -> Column:
    """Format from the extension (``part-0.snappy.parquet`` -> parquet, ``x.csv.gz`` -> csv)."""
    name = F.substring_index(path, "/", -1)  # match on the short file name only
    ext = F.lower(F.regexp_extract(name, _EXT, 1))
    return F.when(ext == "", F.lit("unknown")).otherwise(ext)


def source_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Per format: ``files``, ``total_bytes``, ``latest_modification``."""
    return (
        list_files(spark, path)
        .groupBy("format")
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.sum("length").alias("total_bytes"),
            F.max("modificationTime").alias("latest_modification"),
        )
    )


def sink_layout(spark: SparkSession, path: str) -> DataFrame:
    """R2 re-aimed: input bytes below ``path`` -> a partition count for the sink, in Spark."""
    total = list_files(spark, path).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes"))
    return total.withColumn("partitions", partitions_for_bytes(F.col("total_bytes")))
