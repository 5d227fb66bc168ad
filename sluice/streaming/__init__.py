from sluice.streaming.fixtures import write_time_ordered_files
from sluice.streaming.ingest import (
    StreamResult,
    StreamSpec,
    dedupe_within_watermark,
    ingest_plan,
    parse_json_messages,
    read_file_stream,
    read_kafka_stream,
    run_stream_ingest,
    start_stream_files,
    start_stream_ingest,
    stream_result,
    stream_steps,
    with_time_partition,
    write_stream_files,
)

__all__ = [
    "StreamResult",
    "StreamSpec",
    "dedupe_within_watermark",
    "ingest_plan",
    "parse_json_messages",
    "read_file_stream",
    "read_kafka_stream",
    "run_stream_ingest",
    "start_stream_files",
    "start_stream_ingest",
    "stream_result",
    "stream_steps",
    "with_time_partition",
    "write_stream_files",
    "write_time_ordered_files",
]
