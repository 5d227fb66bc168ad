from sluice.sinks.merge import latest_updates, merge_into_path, merge_into_table, merge_partitions, merge_upsert, republish
from sluice.sinks.writer import (
    FORMATS,
    MODES,
    WriteResult,
    partition_manifest,
    prepare_write,
    write_bucketed_table,
    write_table,
    written_partitions,
)

__all__ = [
    "FORMATS",
    "MODES",
    "WriteResult",
    "latest_updates",
    "merge_into_path",
    "merge_into_table",
    "merge_partitions",
    "merge_upsert",
    "partition_manifest",
    "prepare_write",
    "republish",
    "write_bucketed_table",
    "write_table",
    "written_partitions",
]
