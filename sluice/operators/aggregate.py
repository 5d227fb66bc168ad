"""A1 row count, A3 keyed aggregation.

Both are single ``agg`` calls: Catalyst plans a partial aggregate per map task and a final
one after the shuffle, so a hot key is combined map-side before anything moves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions import as_list, named, require_columns

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def row_count(df: DataFrame) -> DataFrame:
    """One row, ``row_count``; usable as a plan fragment instead of a separate ``count()`` action."""
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def numeric_measures(df: DataFrame, keys: Sequence[str]) -> list[str]:
    """The numeric columns that are no key."""
    return [f.name for f in df.schema.fields if f.name not in keys and isinstance(f.dataType, _NUMERIC)]


def aggregate_by_keys(
    df: DataFrame,
    keys: str | Sequence[str],
    measures: str | Sequence[str] | None = None,
    stats: Sequence[str] = ("sum", "avg", "min", "max"),
) -> DataFrame:
    """``groupBy(keys)`` with ``row_count`` plus ``<stat>_<measure>`` for each numeric measure."""
    keys = as_list(keys)
    require_columns(df, keys, "group key")
    if measures is None:
        measures = numeric_measures(df, keys)
    measures = as_list(measures)
    require_columns(df, measures, "measure")
    fns = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}
    unknown = [s for s in stats if s not in fns]
    if unknown:
        raise ValueError(f"unknown statistics {unknown}; known: {sorted(fns)}")
    aggs = [F.count(F.lit(1)).alias("row_count")]
    aggs += [fns[s](named(m)).alias(f"{s}_{m}") for m in measures for s in stats]
    return df.groupBy(*[named(k) for k in keys]).agg(*aggs)
