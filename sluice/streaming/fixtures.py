"""Stream inputs derived from a table: time-ordered files arriving one after another.

A file stream source takes files oldest-modification-first. Files written by one parallel
job get near-identical modification times in no particular order, which would let a later
file move the watermark past an earlier one. So the table is range-partitioned by event time
in one job, and the resulting files are given modification times in time order. Where the
file system does not keep such times (object stores), the files are appended to the stream
folder one at a time instead. This is input preparation for tests and demos, not part of a pipeline.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.sources.inventory import list_files

# Small row groups: a micro-batch of one file is read by several tasks.
ROW_GROUP_BYTES = 4 * 1024**2


def write_time_ordered_files(df: DataFrame, path: str, staging: str, ts_col: str, files: int = 8, arrive_in_order: bool = True) -> int:
    """Write ``df`` as ``files`` parquet files to ``path``, each holding one event-time range.

    ``arrive_in_order=True`` makes the files arrive one by one in time order (needed when a
    watermark must never see a later file first); otherwise they are in no order.
    Returns the number of files written.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(files, F.col(ts_col)).sortWithinPartitions(ts_col)
    if not arrive_in_order:
        ranged.write.mode("error").parquet(path)
        return files
    in_place = _keeps_times(spark, path, staging)
    ranged.write.mode("error").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path if in_place else staging)
    # part-00000 holds the earliest range; names sort in range order.
    if in_place:
        return _set_times_by_name(spark, path)
    parts = [r["path"] for r in list_files(spark, staging).filter(F.col("format") == "parquet").select("path").orderBy("path").collect()]
    for p in parts:  # one path per file
        spark.read.schema(df.schema).parquet(p).coalesce(1).write.mode("append").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return len(parts)


def _file_system(spark, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def _keeps_times(spark, path: str, staging: str) -> bool:
    """Whether a file's modification time can be set where ``path`` is, a new folder: tried on an empty file beside the staged ones."""
    folder, there = _file_system(spark, path)
    if there.getUri().toString() != _file_system(spark, staging)[1].getUri().toString() or there.exists(folder):  # files there keep their place before the new ones
        return False
    probe, fs = _file_system(spark, f"{staging}-times")
    fs.create(probe).close()
    at = fs.getFileStatus(probe).getModificationTime() // 1000 * 1000 - 10_000
    try:
        fs.setTimes(probe, at, -1)
    except Py4JJavaError:  # not supported
        return False
    return fs.getFileStatus(probe).getModificationTime() == at


def _set_times_by_name(spark, path: str) -> int:
    """Modification times a second apart, in the order of the files' names, up to now."""
    folder, fs = _file_system(spark, path)
    found = sorted((f for f in fs.listStatus(folder) if f.getPath().getName().endswith(".parquet")), key=lambda f: f.getPath().getName())
    last = max((f.getModificationTime() for f in found), default=0) // 1000 * 1000
    for i, f in enumerate(found):
        fs.setTimes(f.getPath(), last - (len(found) - 1 - i) * 1000, -1)
    return len(found)
