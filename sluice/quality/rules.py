"""Typed data-quality rules (Q4). A wrong type raises instead of silently meaning "no checks"."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields
from typing import Any

from pyspark.sql import types as T


@dataclass(frozen=True)
class DQRules:
    """Rules evaluated together in one aggregate pass.

    ``null_threshold``: a column fails when its null rate is strictly greater.
    ``dupe_check`` / ``dupe_keys``: duplicate count on the keys (default: first column).
    ``freshness_hours`` + ``freshness_column`` + ``as_of``: newest event must be no older.
    ``min_rows`` and ``expected_columns``: acceptance criteria (reported by ``expectations``).
    ``expected_schema`` (or DDL text): names and types; any drift fails ``all_checks``.
    """

    null_threshold: float = 0.01
    null_columns: tuple[str, ...] | None = None
    dupe_check: bool = False
    dupe_keys: tuple[str, ...] | None = None
    freshness_hours: float | None = None
    freshness_column: str | None = None
    as_of: str | None = None
    min_rows: int | None = None
    expected_columns: tuple[str, ...] | None = None
    expected_schema: T.StructType | None = None

    def __post_init__(self):
        if isinstance(self.null_threshold, bool) or not isinstance(self.null_threshold, (int, float)):
            raise TypeError(f"null_threshold must be a number, not {self.null_threshold!r}")
        if not 0 <= float(self.null_threshold) <= 1:
            raise ValueError(f"null_threshold must be within [0, 1], not {self.null_threshold}")
        if not isinstance(self.dupe_check, bool):
            raise TypeError(f"dupe_check must be a bool, not {self.dupe_check!r}")
        for name in ("null_columns", "dupe_keys", "expected_columns"):
            v = getattr(self, name)
            if v is not None:
                if isinstance(v, str) or not isinstance(v, Sequence) or not all(isinstance(x, str) for x in v):
                    raise TypeError(f"{name} must be a list of column names, not {v!r}")
                object.__setattr__(self, name, tuple(v))
        if self.freshness_hours is not None:
            if isinstance(self.freshness_hours, bool) or not isinstance(self.freshness_hours, (int, float)) or self.freshness_hours < 0:
                raise TypeError(f"freshness_hours must be a non-negative number, not {self.freshness_hours!r}")
            if not self.freshness_column:
                raise ValueError("freshness_hours needs freshness_column")
            if self.as_of is None:
                raise ValueError("freshness_hours needs an explicit as_of so that results repeat")
            _dt.datetime.fromisoformat(str(self.as_of))
        if isinstance(self.expected_schema, str):
            object.__setattr__(self, "expected_schema", T.StructType.fromDDL(self.expected_schema))
        if self.expected_schema is not None and not isinstance(self.expected_schema, T.StructType):
            raise TypeError(f"expected_schema must be a StructType or a DDL string, not {self.expected_schema!r}")
        if self.min_rows is not None and (isinstance(self.min_rows, bool) or not isinstance(self.min_rows, int)):
            raise TypeError(f"min_rows must be an int, not {self.min_rows!r}")

    @classmethod
    def from_dict(cls, rules: Mapping[str, Any]) -> DQRules:
        if not isinstance(rules, Mapping):
            raise TypeError(f"rules must be a mapping, not {type(rules).__name__}")
        known = {f.name for f in fields(cls)}
        unknown = set(rules) - known
        if unknown:
            raise ValueError(f"unknown rule(s) {sorted(unknown)}; known: {sorted(known)}")
        return cls(**dict(rules))


# The two rule sets of the original tool's goals.
ETL_RULES = {"null_threshold": 0.01, "dupe_check": True}
DQ_SUITE_RULES = {"null_threshold": 0.005, "dupe_check": True, "freshness_hours": 2}
