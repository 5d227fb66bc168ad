"""Options that reading and writing must agree on, so that a table we wrote reads back as it was."""

from __future__ import annotations

# Text formats default to millisecond timestamps; keep microseconds instead.
_NTZ = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"
WRITE_OPTIONS = {
    "csv": {"header": "true", "timestampNTZFormat": _NTZ, "timestampFormat": _NTZ + "XXX"},
    "json": {"timestampNTZFormat": _NTZ, "timestampFormat": _NTZ + "XXX"},
}
# A malformed record raises; sluice.sources.read_table can keep such records in a column instead.
READ_OPTIONS = {
    "csv": {"header": "true", "mode": "FAILFAST", "timestampNTZFormat": _NTZ, "timestampFormat": _NTZ + "[XXX]"},
    "json": {"mode": "FAILFAST", "timestampNTZFormat": _NTZ, "timestampFormat": _NTZ + "[XXX]"},
}
