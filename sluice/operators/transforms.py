"""Null fill, safe casts, audit columns, schema migration, derived columns.

Every function is a pure ``DataFrame -> DataFrame`` projection (one ``select`` /
``withColumns``), so Catalyst fuses a whole chain into one whole-stage-codegen span and
still prunes and pushes filters into the scan below it.
"""

from __future__ import annotations

import datetime as _dt
import decimal as _dec
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions import named, require_columns, try_cast_col, typed_literal

# ---------------------------------------------------------------- T2 fill nulls

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _fill_value_fits(dt: T.DataType, v) -> bool:
    if isinstance(v, bool):
        return isinstance(dt, T.BooleanType)
    if isinstance(v, (int, float, _dec.Decimal)):
        if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            return float(v).is_integer()
        return isinstance(dt, _NUMERIC)
    if isinstance(v, str):
        return isinstance(dt, (T.StringType, T.VarcharType, T.CharType))
    if isinstance(v, _dt.datetime):
        return isinstance(dt, (T.TimestampType, T.TimestampNTZType))
    if isinstance(v, _dt.date):
        return isinstance(dt, T.DateType)
    return False


def fill_nulls(df: DataFrame, values: Mapping[str, object] | None = None) -> DataFrame:
    """Replace SQL NULLs per column. An empty map is a no-op, as in the original tool.

    The value's Python type is checked against the column type before any job runs, so a
    bad fill raises a clear ``TypeError`` instead of an ANSI cast error inside a task.
    """
    values = dict(values or {})
    if not values:
        return df
    require_columns(df, list(values), "fill column")
    fills: dict[str, Column] = {}
    for c, v in values.items():
        dt = df.schema[c].dataType
        if v is None or not _fill_value_fits(dt, v):
            raise TypeError(f"cannot fill column {c!r} of type {dt.simpleString()} with {v!r}")
        fills[c] = F.coalesce(named(c), typed_literal(v, dt))
    return df.withColumns(fills)


# ---------------------------------------------------------------- T3 cast types


def cast_types(df: DataFrame, types: Mapping[str, str | T.DataType], strict: bool = False) -> DataFrame:
    """Cast columns. Default is ``try_cast`` (a value that does not fit becomes NULL);
    ``strict=True`` uses ``cast``, which raises under ANSI mode."""
    require_columns(df, list(types), "cast column")
    if strict:
        return df.withColumns({c: named(c).cast(t) for c, t in types.items()})
    return df.withColumns({c: try_cast_col(df, c, t) for c, t in types.items()})


def cast_failures(df: DataFrame, types: Mapping[str, str | T.DataType]) -> DataFrame:
    """Per cast column, how many non-NULL values a ``try_cast`` would turn into NULL.

    One aggregate pass over the source; the result is one row per column.
    """
    require_columns(df, list(types), "cast column")
    names = list(types)
    target_names = {f.name: f.dataType.simpleString() for f in df.select(*[named(c).try_cast(t).alias(c) for c, t in types.items()]).schema.fields}
    aggs = [F.count_if(named(c).isNotNull() & try_cast_col(df, c, t).isNull()).alias(f"_f{i}") for i, (c, t) in enumerate(types.items())]
    aggs.append(F.count(F.lit(1)).alias("_rows"))
    one = df.agg(*aggs)
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(target_names[c]).alias("target_type"),
            F.col(f"_f{i}").alias("failed_count"),
            F.col("_rows").alias("total_rows"),
        )
        for i, c in enumerate(names)
    ])
    return one.select(F.inline(rows))


# ---------------------------------------------------------------- T4 audit columns


def add_audit_columns(df: DataFrame, source_name: str = "sluice", ts_col: str = "_ingestion_ts", source_col: str = "_source") -> DataFrame:
    return df.withColumns({ts_col: F.current_timestamp(), source_col: F.lit(source_name)})


# ---------------------------------------------------------------- T6 schema migration


def migrate_schema(
    df: DataFrame,
    target: T.StructType,
    renames: Mapping[str, str] | None = None,
    defaults: Mapping[str, object] | None = None,
    strict: bool = False,
) -> DataFrame:
    """Bring ``df`` to exactly ``target``: rename, cast, add missing columns (default or
    NULL), drop columns the target lacks, and order as the target does."""
    return df.select(*migration_columns(df, target, renames, defaults, strict))


def migration_columns(
    df: DataFrame,
    target: T.StructType,
    renames: Mapping[str, str] | None = None,
    defaults: Mapping[str, object] | None = None,
    strict: bool = False,
) -> list[Column]:
    """The columns of ``migrate_schema``, in the order of the target."""
    renames = dict(renames or {})
    defaults = dict(defaults or {})
    require_columns(df, list(renames), "renamed column")
    source_of = {new: old for old, new in renames.items()}
    cols = []
    for f in target.fields:
        src = source_of.get(f.name, f.name)
        if src in df.columns:
            c = named(src)
            if df.schema[src].dataType != f.dataType:
                c = c.cast(f.dataType) if strict else try_cast_col(df, src, f.dataType)
        elif f.name in defaults:
            c = typed_literal(defaults[f.name], f.dataType)
        else:
            c = F.lit(None).cast(f.dataType)
        cols.append(c.alias(f.name))
    return cols


# ---------------------------------------------------------------- derived columns


def derive_columns(df: DataFrame, exprs: Mapping[str, str | Column]) -> DataFrame:
    """Add / replace columns from SQL expression strings or Columns (e.g. a ``date`` partition)."""
    return df.withColumns({k: F.expr(v) if isinstance(v, str) else v for k, v in exprs.items()})


def select_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    require_columns(df, cols)
    return df.select(*[named(c) for c in cols])
