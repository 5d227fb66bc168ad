"""Q6: split rows into clean and quarantined, with the broken rule names per row.

Row-level and stateless: one projection adds ``_dq_errors`` (array of rule names whose
condition is false or NULL). Write both sides in one job with
``write_table(tag_rows(df, rules), partition_cols=["_dq_status"])``, or filter twice.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import named

ERRORS = "_dq_errors"
STATUS = "_dq_status"


def not_null_rules(cols: Sequence[str]) -> dict[str, Column]:
    return {f"{c}_not_null": named(c).isNotNull() for c in cols}


def _cond(c: str | Column) -> Column:
    return F.expr(c) if isinstance(c, str) else c


def tag_rows(df: DataFrame, rules: Mapping[str, str | Column]) -> DataFrame:
    """Add ``_dq_errors`` (array<string>) and ``_dq_status`` ('clean' / 'quarantine')."""
    if not rules:
        raise ValueError("quarantine needs at least one rule")
    checks = [F.when(~F.coalesce(_cond(c), F.lit(False)), F.lit(name)) for name, c in rules.items()]
    errors = F.filter(F.array(*checks), lambda x: x.isNotNull())
    tagged = df.withColumn(ERRORS, errors)
    return tagged.withColumn(STATUS, F.when(F.size(F.col(ERRORS)) > 0, "quarantine").otherwise("clean"))


def quarantine(df: DataFrame, rules: Mapping[str, str | Column]) -> tuple[DataFrame, DataFrame]:
    """(clean rows without the tag columns, quarantined rows with ``_dq_errors``)."""
    tagged = tag_rows(df, rules)
    clean = tagged.filter(F.col(STATUS) == "clean").drop(ERRORS, STATUS)
    bad = tagged.filter(F.col(STATUS) == "quarantine").drop(STATUS)
    return clean, bad


def quarantine_summary(df: DataFrame, rules: Mapping[str, str | Column]) -> DataFrame:
    """Rows broken per rule in one aggregate: ``rule, broken_rows, total_rows``."""
    names = list(rules)
    aggs = [F.count_if(~F.coalesce(_cond(c), F.lit(False))).alias(f"_b{i}") for i, c in enumerate(rules.values())]
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *aggs)
    return one.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"_b{i}").alias("broken_rows"), F.col("_rows").alias("total_rows")) for i, n in enumerate(names)]))
    )
