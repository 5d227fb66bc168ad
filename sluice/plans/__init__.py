from sluice.plans.flows import DQGateError, EtlResult, PipelineSpec, build_plan, report_frame, run_dq_suite, run_etl
from sluice.plans.goals import AggregationResult, AggregationSpec, MigrationError, MigrationResult, MigrationSpec, combine_aggregates, migration_changes, run_aggregation, run_migration
from sluice.plans.lineage import SOURCE_FILE, RunMetrics, lineage_edges, lineage_nodes, metrics_frame, run_with_metrics

__all__ = [
    "AggregationResult",
    "AggregationSpec",
    "DQGateError",
    "EtlResult",
    "MigrationError",
    "MigrationResult",
    "MigrationSpec",
    "PipelineSpec",
    "RunMetrics",
    "SOURCE_FILE",
    "build_plan",
    "combine_aggregates",
    "lineage_edges",
    "lineage_nodes",
    "metrics_frame",
    "migration_changes",
    "report_frame",
    "run_aggregation",
    "run_dq_suite",
    "run_etl",
    "run_migration",
    "run_with_metrics",
]
