"""Every data-quality number from ONE job.

The original tool ran one Spark job per column plus two more. Here all rules become
aggregate expressions evaluated in a single job; the long report table is then made from
the resulting one row with ``inline(array(struct(...)))``, in the same job.

Cost at scale: the null counts, row count and max event time are one plain global
aggregate (partial per task, a few bytes each, no shuffle of rows). The duplicate check is
an exact ``count(DISTINCT struct(keys))`` kept in its OWN aggregate branch that reads only
the key columns: Spark plans it as a partial aggregate per key, a shuffle on the key and a
merge, so a hot key is collapsed per map task before the shuffle. (Were it in the same
aggregate as the null counts, Spark would group by the key first and carry every column's
partial null count through that shuffle: C longs per distinct key.) The two one-row results
are combined by ``union`` + ``max``, not by a join.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions import key_struct, micros_between, named, null_count, require_columns, ts_literal_like
from sluice.quality.rules import DQRules

MICROS_PER_HOUR = 3_600_000_000
REPORT_SCHEMA = "check string, column_name string, observed double, threshold double, passed boolean"


def _rules(rules: DQRules | Mapping[str, Any] | None) -> DQRules:
    if rules is None:
        return DQRules()
    if isinstance(rules, DQRules):
        return rules
    return DQRules.from_dict(rules)


class _Pass:
    """The single aggregate over ``df`` and named column expressions over its one row."""

    def __init__(self, df: DataFrame, rules: DQRules):
        self.df = df
        self.rules = rules
        self.null_cols = list(rules.null_columns) if rules.null_columns is not None else list(df.columns)
        require_columns(df, self.null_cols, "null-check column")
        self.keys = list(rules.dupe_keys) if rules.dupe_keys else df.columns[:1]
        aggs = [F.count(F.lit(1)).alias("_rows")]
        aggs += [null_count(c).alias(f"_n{i}") for i, c in enumerate(self.null_cols)]
        if rules.freshness_hours is not None:
            require_columns(df, [rules.freshness_column], "freshness column")
            aggs.append(F.max(named(rules.freshness_column)).alias("_max_ts"))
        one = df.agg(*aggs)
        if rules.dupe_check:
            require_columns(df, self.keys, "duplicate key")
            distinct = df.agg(F.count_distinct(key_struct(self.keys)).alias("_distinct"))
            # two one-row branches -> one row; each column is non-NULL in exactly one branch
            both = one.unionByName(distinct, allowMissingColumns=True)
            one = both.agg(*[F.max(c).alias(c) for c in both.columns])
        # The failure count is derived once on the one-row result and referenced by name, so
        # a 500-column table does not repeat a 500-term sum in every report row.
        self.one = one.withColumn("_fails", self._count_failures())

    # --- expressions over the one-row result
    rows = property(lambda self: F.col("_rows"))

    def nulls(self, i: int) -> Column:
        return F.col(f"_n{i}")

    def rate(self, i: int) -> Column:
        return (self.nulls(i) / F.greatest(self.rows, F.lit(1))).cast("double")

    def null_failed(self, i: int) -> Column:
        return self.rate(i) > F.lit(float(self.rules.null_threshold))

    def _count_failures(self) -> Column:
        flags = [F.when(self.null_failed(i), 1).otherwise(0) for i in range(len(self.null_cols))]
        return F.aggregate(F.array(*flags), F.lit(0), lambda acc, x: acc + x) if flags else F.lit(0)

    def null_failures(self) -> Column:
        return F.col("_fails")

    def score(self) -> Column:
        return F.round(F.greatest(F.lit(0.0), F.lit(100.0) - F.lit(5.0) * self.null_failures()), 1)

    def dupes(self) -> Column:
        return self.rows - F.col("_distinct")

    def lag_hours(self) -> Column:
        as_of = ts_literal_like(self.df, self.rules.freshness_column, str(self.rules.as_of))
        return (micros_between(as_of, F.col("_max_ts")) / F.lit(MICROS_PER_HOUR)).cast("double")

    def fresh(self) -> Column:
        # NULL max (empty table) is not fresh.
        return F.coalesce(self.lag_hours() <= F.lit(float(self.rules.freshness_hours)), F.lit(False))

    def all_passed(self) -> Column:
        ok = self.null_failures() == 0
        if self.rules.dupe_check:
            ok = ok & (self.dupes() == 0)
        if self.rules.freshness_hours is not None:
            ok = ok & self.fresh()
        if self.rules.min_rows is not None:
            ok = ok & (self.rows >= F.lit(self.rules.min_rows))
        if self.rules.expected_columns is not None:
            ok = ok & F.lit(not self.missing_columns())
        if self.rules.expected_schema is not None:
            ok = ok & F.lit(not self.drifted_columns())
        return ok

    def drifted_columns(self) -> list[str]:
        """Columns added, removed or of another type, in the order of the expected schema."""
        wanted = {f.name: f.dataType for f in self.rules.expected_schema.fields}
        actual = {f.name: f.dataType for f in self.df.schema.fields}
        return [c for c in [*wanted, *(c for c in actual if c not in wanted)] if wanted.get(c) != actual.get(c)]

    def missing_columns(self) -> list[str]:
        return [c for c in (self.rules.expected_columns or ()) if c not in self.df.columns]


def _long(one: DataFrame, structs: list[Column]) -> DataFrame:
    return one.select(F.inline(F.array(*structs)))


def _report_row(check: str, column: Column | str | None, observed: Column, threshold: Column | float | None, passed: Column) -> Column:
    col_name = column if isinstance(column, Column) else F.lit(column).cast("string")
    thr = threshold if isinstance(threshold, Column) else F.lit(threshold).cast("double")
    return F.struct(
        F.lit(check).alias("check"),
        col_name.alias("column_name"),
        observed.cast("double").alias("observed"),
        thr.alias("threshold"),
        passed.alias("passed"),
    )


# ------------------------------------------------------------------ public checks


def null_rates(df: DataFrame, threshold: float = 0.01, columns: list[str] | None = None) -> DataFrame:
    """Q1: per column ``null_count``, ``null_rate = nulls / max(rows, 1)``, ``passed`` (rate <= threshold)."""
    p = _Pass(df, DQRules(null_threshold=threshold, null_columns=columns))
    structs = [
        F.struct(
            F.lit(c).alias("column_name"),
            p.nulls(i).alias("null_count"),
            p.rows.alias("total_rows"),
            p.rate(i).alias("null_rate"),
            F.lit(float(threshold)).alias("threshold"),
            (~p.null_failed(i)).alias("passed"),
        )
        for i, c in enumerate(p.null_cols)
    ]
    return _long(p.one, structs)


def duplicates(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Q2 / A2: one row, ``total_rows``, ``distinct_keys``, ``duplicate_count``, ``passed``.

    NULL keys count as one key, the same as ``dropDuplicates``.
    """
    p = _Pass(df, DQRules(null_columns=[], dupe_check=True, dupe_keys=keys))
    return p.one.select(
        F.lit(",".join(p.keys)).alias("key_columns"),
        p.rows.alias("total_rows"),
        F.col("_distinct").alias("distinct_keys"),
        p.dupes().alias("duplicate_count"),
        (p.dupes() == 0).alias("passed"),
    )


def freshness(df: DataFrame, ts_col: str, as_of: str | list[str], max_age_hours: float) -> DataFrame:
    """Q5: one row per ``as_of``: ``as_of``, ``max_ts``, ``lag_hours``, ``max_age_hours``, ``fresh``.

    Several ``as_of`` points share the one ``max`` aggregate.
    """
    points = [as_of] if isinstance(as_of, str) else list(as_of)
    passes = [_Pass(df, DQRules(null_columns=[], freshness_hours=max_age_hours, freshness_column=ts_col, as_of=a)) for a in points]
    structs = [
        F.struct(
            ts_literal_like(df, ts_col, a).alias("as_of"),
            F.col("_max_ts").alias("max_ts"),
            F.round(p.lag_hours(), 6).alias("lag_hours"),
            F.lit(float(max_age_hours)).alias("max_age_hours"),
            p.fresh().alias("fresh"),
        )
        for a, p in zip(points, passes)
    ]
    return _long(passes[0].one, structs)


def dq_score(df: DataFrame, rules: DQRules | Mapping[str, Any] | None = None) -> DataFrame:
    """Q3: one row. ``dq_score`` and ``passed`` count null-rate failures only (as the original
    tool did); ``all_checks_passed`` also includes duplicates, freshness, min rows, columns."""
    p = _Pass(df, _rules(rules))
    cols = [
        p.rows.alias("total_rows"),
        p.null_failures().alias("null_failures"),
        p.score().alias("dq_score"),
        (p.null_failures() == 0).alias("passed"),
    ]
    cols.append((p.dupes() if p.rules.dupe_check else F.lit(None).cast("bigint")).alias("duplicate_count"))
    cols.append((p.fresh() if p.rules.freshness_hours is not None else F.lit(None).cast("boolean")).alias("fresh"))
    cols.append(p.all_passed().alias("all_checks_passed"))
    return p.one.select(*cols)


def dq_report(df: DataFrame, rules: DQRules | Mapping[str, Any] | None = None) -> DataFrame:
    """Q4: the long report, one row per (check, column) plus a ``dq_score`` summary row.

    Columns: ``check, column_name, observed, threshold, passed``. One job.
    """
    p = _Pass(df, _rules(rules))
    r = p.rules
    rows = [p_row for p_row in _null_rows(p)]
    if r.dupe_check:
        rows.append(_report_row("duplicates", ",".join(p.keys), p.dupes(), 0.0, p.dupes() == 0))
    if r.freshness_hours is not None:
        rows.append(_report_row("freshness", r.freshness_column, F.round(p.lag_hours(), 6), float(r.freshness_hours), p.fresh()))
    if r.min_rows is not None:
        rows.append(_report_row("min_rows", None, p.rows, float(r.min_rows), p.rows >= F.lit(r.min_rows)))
    if r.expected_columns is not None:
        missing = p.missing_columns()
        rows.append(_report_row("expected_columns", ",".join(missing) or None, F.lit(len(missing)), 0.0, F.lit(not missing)))
    if r.expected_schema is not None:
        drifted = p.drifted_columns()
        rows.append(_report_row("schema_drift", ",".join(drifted) or None, F.lit(len(drifted)), 0.0, F.lit(not drifted)))
    rows.append(_report_row("dq_score", None, p.score(), None, p.null_failures() == 0))
    rows.append(_report_row("all_checks", None, p.rows, None, p.all_passed()))
    return _long(p.one, rows)


def _null_rows(p: _Pass) -> list[Column]:
    thr = float(p.rules.null_threshold)
    return [_report_row("null_rate", c, F.round(p.rate(i), 6), thr, ~p.null_failed(i)) for i, c in enumerate(p.null_cols)]


def expectations(df: DataFrame, rules: DQRules | Mapping[str, Any]) -> DataFrame:
    """Q7 / P5 / P6 re-aimed: acceptance criteria over the data.

    Columns ``criterion, met, observed, expected``: min rows, expected columns (observed =
    number missing), each null rate, duplicates, freshness; one job.
    """
    p = _Pass(df, _rules(rules))
    r = p.rules

    def row(name: str | Column, met: Column, observed: Column, expected: Column | float | None) -> Column:
        exp = expected if isinstance(expected, Column) else F.lit(expected).cast("double")
        crit = name if isinstance(name, Column) else F.lit(name)
        return F.struct(crit.alias("criterion"), met.alias("met"), observed.cast("double").alias("observed"), exp.alias("expected"))

    rows = []
    if r.min_rows is not None:
        rows.append(row("min_rows", p.rows >= F.lit(r.min_rows), p.rows, float(r.min_rows)))
    if r.expected_columns is not None:
        missing = p.missing_columns()
        rows.append(row("expected_columns", F.lit(not missing), F.lit(len(missing)), 0.0))
    for i, c in enumerate(p.null_cols):
        rows.append(row(f"null_rate:{c}", ~p.null_failed(i), F.round(p.rate(i), 6), float(r.null_threshold)))
    if r.dupe_check:
        rows.append(row(f"duplicates:{','.join(p.keys)}", p.dupes() == 0, p.dupes(), 0.0))
    if r.freshness_hours is not None:
        rows.append(row(f"freshness:{r.freshness_column}", p.fresh(), F.round(p.lag_hours(), 6), float(r.freshness_hours)))
    rows.append(row("all", p.all_passed(), F.lit(None), None))
    return _long(p.one, rows)


# ------------------------------------------------------------------ profiling


def schema_profile(df: DataFrame) -> DataFrame:
    """``position, column_name, data_type, nullable, total_rows, null_count, non_null_count``."""
    p = _Pass(df, DQRules())
    structs = [
        F.struct(
            F.lit(i + 1).alias("position"),
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.lit(f.nullable).alias("nullable"),
            p.rows.alias("total_rows"),
            p.nulls(i).alias("null_count"),
            (p.rows - p.nulls(i)).alias("non_null_count"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return _long(p.one, structs)


def schema_drift(df: DataFrame, expected: T.StructType) -> DataFrame:
    """Compare the read schema with the expected one.

    One row per column of either side: ``column_name, expected_type, actual_type, change``
    (``added`` / ``removed`` / ``type_changed`` / ``unchanged``) and ``non_null_count`` for
    added columns. The comparison itself is schema metadata; the counts are one aggregate.
    """
    actual = {f.name: f.dataType for f in df.schema.fields}
    wanted = {f.name: f.dataType for f in expected.fields}
    names = list(wanted) + [c for c in actual if c not in wanted]
    added = [c for c in actual if c not in wanted]
    if added:
        base = df.agg(*[F.count(named(c)).alias(f"_nn{i}") for i, c in enumerate(added)])
    else:
        base = df.sparkSession.range(1)
    structs = []
    for c in names:
        e, a = wanted.get(c), actual.get(c)
        change = "added" if e is None else "removed" if a is None else "type_changed" if e != a else "unchanged"
        nn = F.col(f"_nn{added.index(c)}") if c in added else F.lit(None).cast("bigint")
        structs.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(e.simpleString() if e else None).cast("string").alias("expected_type"),
                F.lit(a.simpleString() if a else None).cast("string").alias("actual_type"),
                F.lit(change).alias("change"),
                nn.alias("non_null_count"),
            )
        )
    return _long(base, structs)


def has_drift(expected: T.StructType, actual: T.StructType) -> bool:
    return {f.name: f.dataType for f in expected.fields} != {f.name: f.dataType for f in actual.fields}
