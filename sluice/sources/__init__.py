from sluice.sources.files import FILE_FORMATS, CorruptInputError, read_delta, read_jdbc, read_table, split_corrupt
from sluice.sources.inventory import file_format, list_files, sink_layout, source_inventory

__all__ = [
    "FILE_FORMATS",
    "CorruptInputError",
    "file_format",
    "list_files",
    "read_delta",
    "read_jdbc",
    "read_table",
    "sink_layout",
    "source_inventory",
    "split_corrupt",
]
