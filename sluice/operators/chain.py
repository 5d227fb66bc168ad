"""T5: an ordered list of named steps applied with ``DataFrame.transform``.

Names must match exactly; an unknown name raises (the original tool matched substrings
and skipped unknown names silently, so ``drop_nulls`` would dedupe).
A step is a name (``"deduplicate"``) or a dict ``{"op": name, **arguments}``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame

from sluice.operators.dedupe import dedupe
from sluice.operators.transforms import add_audit_columns, cast_types, derive_columns, fill_nulls, migrate_schema, select_columns

STEPS: dict[str, Callable[..., DataFrame]] = {
    "deduplicate": dedupe,
    "fill_nulls": fill_nulls,
    "cast_types": cast_types,
    "add_audit_columns": add_audit_columns,
    "migrate_schema": migrate_schema,
    "derive_columns": derive_columns,
    "select_columns": select_columns,
}


def _parse(step: str | Mapping[str, Any]) -> tuple[str, dict[str, Any]]:
    if isinstance(step, str):
        return step, {}
    if isinstance(step, Mapping):
        args = dict(step)
        name = args.pop("op", None)
        if not isinstance(name, str):
            raise ValueError(f"step {step!r} has no 'op' name")
        return name, args
    raise TypeError(f"a step is a name or a dict, not {type(step).__name__}")


def apply_steps(df: DataFrame, steps: Sequence[str | Mapping[str, Any]]) -> DataFrame:
    """Apply the steps in order. Builds one lazy plan; nothing runs here."""
    for step in steps:
        name, args = _parse(step)
        fn = STEPS.get(name)
        if fn is None:
            raise ValueError(f"unknown step {name!r}; known steps: {sorted(STEPS)}")
        df = df.transform(fn, **args)
    return df


def step_name(step: str | Mapping[str, Any]) -> str:
    return _parse(step)[0]


def step_names(steps: Sequence[str | Mapping[str, Any]]) -> list[str]:
    return [step_name(s) for s in steps]
