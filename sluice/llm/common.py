"""Helpers shared by the operators: word pattern, stable sampling, staged tables, Arrow batches."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.session import scratch_path

#: A word is a maximal run of anything but space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: The same six bytes, as a lookup over byte values.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def col(df: DataFrame, name: str) -> Column:
    """A column by its plain name, dots included."""
    return df["`" + name.replace("`", "``") + "`"]


def in_training(doc_id: Column, folds: int = 5) -> Column:
    """True where crc32 of the id's decimal text is not divisible by ``folds`` (null ids: true)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds != 0, F.lit(True))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def trim() -> None:
    """Gives freed memory of this Python worker, which later tasks reuse, back to the machine (where the C library can)."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def lean() -> None:
    """At the start of a task: Arrow allocates where ``trim`` works, and nothing of earlier tasks stays."""
    pa.set_memory_pool(pa.system_memory_pool())
    trim()


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Python strings of an Arrow string column, null as the empty text."""
    return [t or "" for t in column.to_pylist()]


def slices(batch: pa.RecordBatch, column: str, limit: int):
    """Pieces of the batch that hold about ``limit`` bytes of ``column`` or one row."""
    offsets = np.concatenate(([0], np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


#: Space characters as a string, for trimming.
SPACES = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    """Array of the words of a text, by built-in functions; empty for a null or blank text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def array_literal(numbers, kind: str = "int") -> Column:
    """A constant array, folded to one literal by the optimizer (a subquery may not stand inside a lambda)."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast(f"array<{kind}>")


def let(value: Column, body) -> Column:
    """``body`` of the value, which is computed once (a lambda's variable is never inlined)."""
    return F.transform(F.array(value), body)[0]
