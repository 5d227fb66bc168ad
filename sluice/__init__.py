"""sluice: batch and streaming table pipelines with one-pass data quality, on Spark.

Every operator is a plain ``DataFrame -> DataFrame`` function (or a writer that returns
what it wrote); there is no shared state and nothing is simulated. The most used entry
points are re-exported here; everything else lives in the subpackages.
"""

from sluice.operators import add_audit_columns, apply_steps, cast_types, dedupe, fill_nulls, migrate_schema
from sluice.plans import PipelineSpec, lineage_edges, run_dq_suite, run_etl
from sluice.quality import DQRules, dq_report, dq_score, expectations, null_rates, quarantine
from sluice.sinks import merge_partitions, merge_upsert, write_table
from sluice.sources import read_table, source_inventory
from sluice.streaming import StreamSpec, run_stream_ingest

__version__ = "0.1.0"

__all__ = [
    "DQRules",
    "PipelineSpec",
    "StreamSpec",
    "add_audit_columns",
    "apply_steps",
    "cast_types",
    "dedupe",
    "dq_report",
    "dq_score",
    "expectations",
    "fill_nulls",
    "lineage_edges",
    "merge_partitions",
    "merge_upsert",
    "migrate_schema",
    "null_rates",
    "quarantine",
    "read_table",
    "run_dq_suite",
    "run_etl",
    "run_stream_ingest",
    "source_inventory",
    "write_table",
]
