from sluice.quality.checks import (
    REPORT_SCHEMA,
    dq_report,
    dq_score,
    duplicates,
    expectations,
    freshness,
    has_drift,
    null_rates,
    schema_drift,
    schema_profile,
)
from sluice.quality.quarantine import not_null_rules, quarantine, quarantine_summary, tag_rows
from sluice.quality.rules import DQ_SUITE_RULES, ETL_RULES, DQRules

__all__ = [
    "DQRules",
    "DQ_SUITE_RULES",
    "ETL_RULES",
    "REPORT_SCHEMA",
    "dq_report",
    "dq_score",
    "duplicates",
    "expectations",
    "freshness",
    "has_drift",
    "not_null_rules",
    "null_rates",
    "quarantine",
    "quarantine_summary",
    "schema_drift",
    "schema_profile",
    "tag_rows",
]
