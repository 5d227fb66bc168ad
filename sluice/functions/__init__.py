from sluice.functions.columns import (
    as_list,
    day_bucket,
    event_time,
    hour_bucket,
    is_ntz,
    key_struct,
    micros_between,
    named,
    null_count,
    quoted,
    require_columns,
    require_orderable,
    try_cast_col,
    ts_literal_like,
    typed_literal,
)

__all__ = [
    "as_list",
    "day_bucket",
    "event_time",
    "hour_bucket",
    "is_ntz",
    "key_struct",
    "micros_between",
    "named",
    "null_count",
    "quoted",
    "require_columns",
    "require_orderable",
    "try_cast_col",
    "ts_literal_like",
    "typed_literal",
]
