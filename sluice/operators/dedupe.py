"""Keyed deduplication.

``keep="any"`` is Spark's ``dropDuplicates`` (arbitrary survivor, like the original tool).
``keep="first"`` / ``"last"`` pick a deterministic survivor per key: the row with the
smallest / largest ``order_by`` values, ties broken by all remaining columns in frame
order. It is one ``groupBy(keys).agg(min|max(struct(order..., rest...)))``, so Spark does a
partial aggregate before the shuffle: a key holding a third of all rows is first
collapsed to one row per map task. (``row_number() = 1`` over a window also keeps one row per key and task
before the shuffle, as Spark plans a group limit on both sides; the aggregate needs no sort by the order columns.) NULL keys form one group; NULL order values sort first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions import as_list, named, require_columns, require_orderable

_SURVIVOR = "_sluice_survivor"


def dedupe(
    df: DataFrame,
    keys: str | Sequence[str] | None = None,
    order_by: str | Sequence[str] | None = None,
    keep: str = "first",
) -> DataFrame:
    """Keep one row per key. ``keys`` defaults to the first column."""
    keys = as_list(keys) or [df.columns[0]]
    order = as_list(order_by)
    require_columns(df, keys, "key column")
    require_columns(df, order, "order column")
    require_orderable(df, keys, "dedupe keys")
    if keep == "any":
        return df.dropDuplicates(keys)
    if keep not in ("first", "last"):
        raise ValueError(f"keep must be 'first', 'last' or 'any', not {keep!r}")

    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*[named(k) for k in keys]).distinct()
    ranking = [c for c in order if c not in keys] + [c for c in rest if c not in order]
    require_orderable(df, ranking, "dedupe order / value columns")
    # Order fields first, then every other value column: a total order on the rest of the row.
    fields = [named(c).alias(f"_o{i}") for i, c in enumerate(ranking)]
    pick = F.min if keep == "first" else F.max
    survivor = pick(F.struct(*fields)).alias(_SURVIVOR)
    back = {c: F.col(f"{_SURVIVOR}._o{i}").alias(c) for i, c in enumerate(ranking)}
    return (
        df.groupBy(*[named(k) for k in keys])
        .agg(survivor)
        .select(*[back[c] if c in back else named(c) for c in df.columns])
    )


def duplicate_rows(df: DataFrame, keys: str | Sequence[str] | None = None) -> DataFrame:
    """Rows removed by :func:`dedupe` would be ``count - distinct``; this gives per-key counts > 1."""
    keys = as_list(keys) or [df.columns[0]]
    require_columns(df, keys, "key column")
    return df.groupBy(*[named(k) for k in keys]).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)
