"""R1 repartition, R2 partition-count choice from input size, P3 partition skew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import as_list, require_columns

# Fixed values (size tiers for the default sink partition count):
# under 10 GiB -> 50 partitions; under 100 GiB -> 200; otherwise 400.
GIB = 1024**3
SIZE_TIERS = ((10 * GIB, 50), (100 * GIB, 200))
LARGEST_TIER_PARTITIONS = 400
TARGET_PARTITION_BYTES = 256 * 1024**2


def repartition_rows(df: DataFrame, num_partitions: int | None = None, cols: str | Sequence[str] | None = None, by_range: bool = False) -> DataFrame:
    """Hash (or range) repartition. The multiset of rows is unchanged."""
    cols = as_list(cols)
    require_columns(df, cols, "partition column")
    if by_range:
        if not cols:
            raise ValueError("range partitioning needs at least one column")
        return df.repartitionByRange(num_partitions, *cols) if num_partitions else df.repartitionByRange(*cols)
    if num_partitions and cols:
        return df.repartition(num_partitions, *cols)
    if num_partitions:
        return df.repartition(num_partitions)
    if cols:
        return df.repartition(*cols)
    raise ValueError("give num_partitions, cols or both")


def partitions_for_bytes(total_bytes: Column) -> Column:
    """Partition count for a sink from input bytes, as a Spark expression.

    The size tiers give a floor; above it, one partition per ``TARGET_PARTITION_BYTES`` so the
    count keeps growing with the data (a fixed 400 would make 250 GB tasks at 100 TB).
    """
    tier = F.lit(LARGEST_TIER_PARTITIONS)
    for limit, parts in reversed(SIZE_TIERS):
        tier = F.when(total_bytes < F.lit(limit), F.lit(parts)).otherwise(tier)
    by_size = F.ceil(total_bytes / F.lit(TARGET_PARTITION_BYTES)).cast("int")
    return F.greatest(tier, by_size)


def partition_skew(df: DataFrame) -> DataFrame:
    """Rows per Spark partition of ``df`` as planned (P3: the partition count, and its skew)."""
    return df.groupBy(F.spark_partition_id().alias("partition_id")).agg(F.count(F.lit(1)).alias("rows"))


def partition_summary(df: DataFrame) -> DataFrame:
    """One row: non-empty partitions, min / max / mean rows and max-to-mean skew ratio."""
    per = partition_skew(df)
    return per.agg(
        F.count(F.lit(1)).alias("partitions"),
        F.min("rows").alias("min_rows"),
        F.max("rows").alias("max_rows"),
        F.avg("rows").alias("mean_rows"),
        (F.max("rows") / F.avg("rows")).alias("skew_ratio"),
    )
