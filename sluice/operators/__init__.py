from sluice.operators.aggregate import aggregate_by_keys, row_count
from sluice.operators.chain import STEPS, apply_steps, step_names
from sluice.operators.dedupe import dedupe, duplicate_rows
from sluice.operators.layout import partition_skew, partition_summary, partitions_for_bytes, repartition_rows
from sluice.operators.transforms import (
    add_audit_columns,
    cast_failures,
    cast_types,
    derive_columns,
    fill_nulls,
    migrate_schema,
    select_columns,
)

__all__ = [
    "STEPS",
    "add_audit_columns",
    "aggregate_by_keys",
    "apply_steps",
    "cast_failures",
    "cast_types",
    "dedupe",
    "derive_columns",
    "duplicate_rows",
    "fill_nulls",
    "migrate_schema",
    "partition_skew",
    "partition_summary",
    "partitions_for_bytes",
    "repartition_rows",
    "row_count",
    "select_columns",
    "step_names",
]
