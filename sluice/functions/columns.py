"""Column-expression helpers shared by the operators (all JVM-side built-ins)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_list(cols: str | Iterable[str] | None) -> list[str]:
    if cols is None:
        return []
    if isinstance(cols, str):
        return [cols]
    return list(cols)


def quoted(name: str) -> str:
    """A column name as one identifier: dots and backticks in it are part of the name."""
    return "`" + name.replace("`", "``") + "`"


def named(name: str) -> Column:
    """The column of exactly this name (``F.col`` would read a dot as a struct field)."""
    return F.col(quoted(name))


def require_columns(df: DataFrame, cols: Sequence[str], what: str = "column") -> None:
    """Raise before any job runs when a named column is missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"unknown {what}(s) {missing}; frame has {df.columns}")


def _has_map(dt: T.DataType) -> bool:
    if isinstance(dt, T.MapType):
        return True
    if isinstance(dt, T.StructType):
        return any(_has_map(f.dataType) for f in dt.fields)
    if isinstance(dt, T.ArrayType):
        return _has_map(dt.elementType)
    return False


def require_orderable(df: DataFrame, cols: Sequence[str], what: str) -> None:
    """Map values can be neither grouped nor ordered in Spark; say so up front."""
    bad = [c for c in cols if _has_map(df.schema[c].dataType)]
    if bad:
        raise TypeError(f"{what} cannot contain map-typed columns {bad}")


def null_count(c: str) -> Column:
    """Number of SQL NULLs in a column (NaN and '' are values, not nulls)."""
    return F.count_if(named(c).isNull())


def key_struct(keys: Sequence[str]) -> Column:
    """A never-null struct of the key columns.

    ``count(DISTINCT struct(k...))`` counts a NULL key once, the way ``dropDuplicates`` does,
    whereas ``count(DISTINCT k)`` would skip it.
    """
    return F.struct(*[named(k) for k in keys])


def is_ntz(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.TimestampNTZType)


def event_time(df: DataFrame, c: str) -> Column:
    """Column ``c`` as a session-zone TIMESTAMP; watermarks reject TIMESTAMP_NTZ."""
    dt = df.schema[c].dataType
    if isinstance(dt, T.TimestampType):
        return named(c)
    return named(c).cast("timestamp")


def ts_literal_like(df: DataFrame, c: str, value: str) -> Column:
    """A timestamp literal with the same type (NTZ or LTZ) as column ``c``."""
    return F.lit(value).cast("timestamp_ntz" if is_ntz(df, c) else "timestamp")


def hour_bucket(c: str) -> Column:
    """Hour of an event as text, e.g. ``2024-01-05-13`` (a path-safe partition value)."""
    return _time_text(c, 13)


def day_bucket(c: str) -> Column:
    return _time_text(c, 10)


def _time_text(c: str, chars: int) -> Column:
    """``yyyy-MM-dd[-HH]`` of a time column. The text of a value is its wall clock (an NTZ value's own,
    a TIMESTAMP's in the session zone); no cast between the two shifts an hour that the zone skips."""
    return F.replace(F.substring(named(c).cast("timestamp_ntz").cast("string"), 1, chars), F.lit(" "), F.lit("-"))


def micros_between(later: Column, earlier: Column) -> Column:
    """Microseconds from ``earlier`` to ``later``, both of one type. NTZ values are compared as wall
    clocks: their difference does not pass through the session zone."""
    d = later - earlier
    parts = {"DAY": 86_400_000_000, "HOUR": 3_600_000_000, "MINUTE": 60_000_000, "SECOND": 1_000_000}
    return sum((F.extract(F.lit(u), d).cast("decimal(20,6)") * F.lit(m) for u, m in parts.items()), F.lit(0)).cast("bigint")


_DIGIT_GUARDED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)


def try_cast_col(df: DataFrame, c: str, target: str | T.DataType) -> Column:
    """``try_cast`` of column ``c``, fast on text that cannot be a number.

    Casting a non-numeric string to an integral or decimal type returns NULL, but Spark gets
    there through a slow failure path (about 10x the cost of a good value). Any string that
    does cast to those types contains a decimal digit (``\\p{Nd}``, which also covers the
    non-ASCII digits ``BigDecimal`` accepts), so strings without one are NULL up front; the
    result is identical to a plain ``try_cast``.
    """
    out = named(c).try_cast(target)
    src = df.schema[c].dataType
    if isinstance(src, T.StringType):
        dst = df.select(out.alias("_t")).schema[0].dataType
        if isinstance(dst, _DIGIT_GUARDED):
            return F.when(named(c).rlike(r"\p{Nd}"), out)
    return out


def typed_literal(value, dt: T.DataType) -> Column:
    """A literal of type ``dt``. A ``datetime`` for a TIMESTAMP_NTZ column is passed as its
    wall-clock text, so neither the Python process's nor the session's time zone shifts it."""
    import datetime as _dt

    if isinstance(dt, T.TimestampNTZType) and isinstance(value, _dt.datetime):
        return F.lit(value.isoformat(sep=" ")).cast(dt)
    return F.lit(value).cast(dt)
