"""Documents in blocks of adjacent ids, and keys exchanged between blocks through buckets.

A block holds the documents of one range of ids, so that an earlier block has only smaller ids: which
of two equal keys comes first is known from the block alone, without shipping ids. Blocks
send each distinct key once (sorted, delta-coded, compressed) to the bucket of its leading bits; a
bucket compares the blocks' keys and answers each block with a few bits per key, in the same
order. A key that occurs in a third of all documents is thus at most one entry per block.

Null texts are empty texts. Null ids count as one id after all others. Rows with one id are in
one block, in the order of their texts, or in several blocks of that id alone. ``block_bytes`` (bytes of text; a longer single
text is a block of its own) and ``bucket_bytes`` (bytes of text per bucket) bound a task's memory.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, col, slices, staged, trim

NO_ID = 2**63 - 1
ROWS = "block int, kind int, bucket long, ids binary, lens binary, body binary"
ROWS_ARROW = pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int64()), ("ids", pa.binary()), ("lens", pa.binary()), ("body", pa.binary())])
#: Kinds of rows.
TEXT, KEYS, ANSWER, LATER, STATE = 0, 1, 2, 3, 4


class Layout:
    """Which block a row belongs to.

    Blocks are ranges of ids with about ``block_bytes`` of text each: quantiles of the ids are cut finer where they hold
    more, and neighbours are merged while they fit. An id of more than ``block_bytes`` in several rows (a null id, say)
    has several blocks of its own, by a hash of the text, and its equal rows travel as one row with a number.
    Blocks of one id have the same ``rank``; otherwise ranks ascend with the ids.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, block_bytes: int, bucket_bytes: int):
        self.two = docs.select(F.coalesce(col(docs, id_col).cast("long"), F.lit(NO_ID)).alias("id"), col(docs, text_col).alias("text"))
        sizes = staged(self.two.select("id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes")), "layout-sizes")
        self.total = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()["b"]
        self.buckets = max(1, -(-self.total // bucket_bytes))
        blocks = max(1, -(-self.total // block_bytes))
        bounds = np.zeros(0, np.int64)
        if blocks > 1:
            at = sizes.agg(F.percentile_approx("id", [i / (4 * blocks) for i in range(1, 4 * blocks)], max(10_000, 80 * blocks)).alias("at")).first()["at"]
            bounds = np.unique(np.array(at, np.int64))
        cells = _cell_sizes(sizes, bounds)
        while blocks > 1 and (heavy := [c for c, (n, least, most, _) in cells.items() if n > block_bytes and least < most]):
            cuts = _placed(sizes, bounds, heavy).groupBy("cell").agg(F.percentile_approx("id", [i / 16 for i in range(1, 16)], 10_000).alias("at"), F.min("id").alias("least")).collect()
            found = {x for r in cuts for x in r["at"] if x > r["least"]} | {cells[c][2] for c in heavy}  # the largest id of a cell ends it in any case
            bounds = np.unique(np.concatenate((bounds, np.array(sorted(found), np.int64))))
            cells = _cell_sizes(sizes, bounds)
        # ranks: neighbours merged up to block_bytes; a repeated id of more has blocks of its own
        starts, numbers, held = [], [], block_bytes + 1
        self.hot: list[int] = []
        for c in sorted(cells):
            n, least, _, rows = cells[c]
            many = n > block_bytes and rows > 1 and blocks > 1
            if held + n > block_bytes or many:
                starts.append(least)
                numbers.append(-(-n // block_bytes) if many else 1)
                held = 0
            held = block_bytes + 1 if many else held + n
            self.hot += [least] if many else []
        self.bounds = np.array(starts[1:], np.int64)
        self.parts = np.array(numbers or [1], np.int64)
        self.rank = np.repeat(np.arange(len(self.parts)), self.parts)
        self.blocks = len(self.rank)

    def shared(self, block: int) -> bool:
        """True if the block is one of several of an id."""
        return bool(self.parts[self.rank[block]] > 1)

    def pack(self) -> DataFrame:
        """Rows of kind TEXT: the documents of a batch that belong to one block, compressed together; ``ids`` and then the
        numbers of equal rows, which are 1 but for an id with blocks of its own."""
        bounds, parts = self.bounds, self.parts
        first = np.cumsum(parts) - parts

        def pack(batches):
            pa.set_memory_pool(pa.system_memory_pool())  # gives freed batches back to the machine
            coder = zstandard.ZstdCompressor(level=3)
            for batch in batches:
                for part in slices(batch, "text", 4 << 20):
                    ids, times = (part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "times"))
                    place = np.searchsorted(bounds, ids, "right")
                    block = first[place]
                    texts = part.column("text").cast(pa.binary()).to_pylist()
                    for i in np.flatnonzero(parts[place] > 1).tolist():
                        block[i] += zlib.crc32(texts[i] or b"") % int(parts[place[i]])
                    rows = []
                    for b in np.unique(block):
                        own = np.flatnonzero(block == b)
                        got = [texts[i] or b"" for i in own]
                        rows.append((int(b), TEXT, 0, ids[own].tobytes() + times[own].tobytes(), np.array([len(g) for g in got], np.int64).tobytes(), coder.compress(b"".join(got))))
                    yield arrow(rows)
            trim()

        rows = self.two.withColumn("times", F.lit(1).cast("long"))
        if self.hot:
            ids = self.two.sparkSession.createDataFrame([(i,) for i in self.hot], "h_id long")
            equal = self.two.join(ids, F.col("id") == F.col("h_id"), "left_semi").groupBy("id", F.coalesce("text", F.lit("")).alias("text")).agg(F.count("*").alias("times"))
            rows = rows.join(ids, F.col("id") == F.col("h_id"), "left_anti").unionByName(equal)
        return rows.mapInArrow(pack, ROWS)

    def expanded(self, result: DataFrame) -> DataFrame:
        """Each row as often as its column ``times`` says."""
        if not self.hot:
            return result.drop("times")
        return result.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("times")


def _placed(sizes: DataFrame, bounds: np.ndarray, only: list[int] | None = None) -> DataFrame:
    """cell, id, bytes; of the cells ``only``."""
    chosen = None if only is None else np.array(only)

    def work(batches):
        for batch in batches:
            cell = np.searchsorted(bounds, batch.column("id").to_numpy(), "right")
            out = pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), batch.column("id"), batch.column("bytes")], ["cell", "id", "bytes"])
            yield out if chosen is None else out.filter(pa.array(np.isin(cell, chosen)))

    return sizes.mapInArrow(work, "cell long, id long, bytes long")


def _cell_sizes(sizes: DataFrame, bounds: np.ndarray) -> dict[int, tuple[int, int, int, int]]:
    """cell -> bytes, least and largest id, rows."""
    found = _placed(sizes, bounds).groupBy("cell").agg(F.sum("bytes").alias("n"), F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("rows")).collect()
    return {r["cell"]: (r["n"], r["least"], r["most"], r["rows"]) for r in found}


def arrow(rows: list[tuple], schema: pa.Schema = ROWS_ARROW) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def per_block(rows: DataFrame, work, schema: str = ROWS, arrow_schema: pa.Schema = ROWS_ARROW, answers: DataFrame | None = None, with_times: bool = False) -> DataFrame:
    """``work(block, ids, texts, answers)`` for each block yields rows; ids ascend, ``answers(kind)``
    are the bodies of that kind in the order of the buckets. The texts are shuffled alone, not with the answers, so that
    several passes over them in one plan share one exchange. ``with_times``: work yields one row per text, which gets
    the number of equal rows as its last column, ``times``."""
    if with_times:
        schema, arrow_schema = schema + ", times long", arrow_schema.append(pa.field("times", pa.int64()))

    def run(texts_of_block: pa.Table, answered: pa.Table | None) -> pa.Table:
        pa.set_memory_pool(pa.system_memory_pool())
        decoder = zstandard.ZstdDecompressor()
        ids, times, texts = [], [], []
        for r in texts_of_block.to_pylist():
            lens, at = np.frombuffer(r["lens"], np.int64), 0
            body = decoder.decompress(r["body"], max_output_size=int(lens.sum()) + 1)
            both = np.frombuffer(r["ids"], np.int64)
            ids.append(both[: len(both) // 2])
            times.append(both[len(both) // 2 :])
            for n in lens.tolist():
                texts.append(body[at : at + n])
                at += n
        if not texts:
            return pa.Table.from_batches([], arrow_schema)
        own = np.concatenate(ids)
        order = sorted(range(len(texts)), key=lambda i: (own[i], texts[i]))
        block = texts_of_block.column("block")[0].as_py()
        got = [] if answered is None else sorted((r["kind"], r["bucket"], decoder.decompress(r["body"])) for r in answered.select(["kind", "bucket", "body"]).to_pylist())
        out = list(work(block, own[order], [texts[i] for i in order], lambda kind: [a for k, _, a in got if k == kind]))
        if with_times:
            out = [(*row, n) for row, n in zip(out, np.concatenate(times)[order].tolist(), strict=True)]
        done = pa.Table.from_batches([arrow(out, arrow_schema)], arrow_schema)
        del out, texts, got
        trim()
        return done

    if answers is None:
        return rows.groupBy("block").applyInArrow(lambda table: run(table, None), schema)
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda left, right: run(left, right), schema)


def per_bucket(rows: DataFrame, work, schema: str = ROWS, arrow_schema: pa.Schema = ROWS_ARROW) -> DataFrame:
    """``work(bucket, blocks, bodies)`` for each bucket, in the order of the blocks, yields rows. Rows of kind STATE, which
    have a bucket under 0, are handed on unchanged: what a block keeps for its next pass."""

    def run(table: pa.Table) -> pa.Table:
        pa.set_memory_pool(pa.system_memory_pool())
        if table.column("bucket")[0].as_py() < 0:
            return table.select(arrow_schema.names).cast(arrow_schema)
        parts = sorted(((r["block"], r["body"]) for r in table.select(["block", "body"]).to_pylist()), key=lambda p: p[0])
        bucket = table.column("bucket")[0].as_py()
        del table
        done = pa.Table.from_batches([arrow(list(work(bucket, [b for b, _ in parts], [x for _, x in parts])), arrow_schema)], arrow_schema)
        del parts
        trim()
        return done

    return rows.where(F.col("kind").isin(KEYS, STATE)).groupBy("bucket").applyInArrow(run, schema)


def encode_sorted(keys: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit keys: differences, byte planes, compressed."""
    steps = np.diff(keys, prepend=np.uint64(0))
    planes = steps.view(np.uint8).reshape(-1, 8)
    planes = planes[:, : max(1, 8 - int((planes[1:].max(0, initial=0)[::-1] > 0).argmax()))] if len(keys) > 1 and not planes[1:, 7].any() else planes
    head = keys[:1].tobytes() if len(keys) else b"\0" * 8
    return head + bytes([planes.shape[1]]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes.T).tobytes())


def decode_sorted(data: bytes) -> np.ndarray:
    first, width = np.frombuffer(data[:8], np.uint64)[0], data[8]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[9:]), np.uint8).reshape(width, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :width] = planes.T
    steps = steps.view(np.uint64).ravel()
    if len(steps):
        steps[0] = first
    return np.cumsum(steps, dtype=np.uint64)


def compress(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def bucket_slices(keys: np.ndarray, buckets: int, bits: int = 64):
    """(bucket, start, end) of ascending keys, by equal ranges of the key space."""
    edges = np.array([(b << bits) // buckets for b in range(1, buckets)], np.uint64)
    at = np.concatenate(([0], np.searchsorted(keys, edges, "left"), [len(keys)]))
    for b in range(buckets):
        if at[b] < at[b + 1]:
            yield b, int(at[b]), int(at[b + 1])


# ---------------------------------------------------------------- hashes

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
UNBASE = np.uint64(pow(int(BASE), -1, 2**64))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (the finalizer of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def byte_values(lower: bool = False) -> np.ndarray:
    """A 64-bit number per byte value; A-Z like a-z if ``lower``; spaces 0."""
    v = mix(np.arange(1, 257, dtype=np.uint64) * BASE) | np.uint64(1)
    if lower:
        v[65:91] = v[97:123]
    v[IS_SPACE] = 0
    return v


def powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    if n:
        p[0] = 1
    return np.multiply.accumulate(p)


def word_hashes(data: bytes, lower: bool = False, chunk: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Start positions and 64-bit polynomial hashes of the words of UTF-8 data."""
    buf, values = np.frombuffer(data, np.uint8), byte_values(lower)
    starts, hashes, at = [], [], 0
    pw, un = powers(BASE, min(len(buf), 2 * chunk) + 1), powers(UNBASE, min(len(buf), 2 * chunk) + 1)
    while at < len(buf):
        end = min(len(buf), at + chunk)
        if end < len(buf):  # up to the next space, so that no word is cut
            more = np.flatnonzero(IS_SPACE[buf[end : end + chunk]])
            while not len(more) and end < len(buf):
                end = min(len(buf), end + chunk)
                more = np.flatnonzero(IS_SPACE[buf[end : end + chunk]])
            end += int(more[0]) if len(more) else 0
        part = buf[at:end]
        if len(part) > len(pw):
            pw, un = powers(BASE, len(part) + 1), powers(UNBASE, len(part) + 1)
        space = IS_SPACE[part]
        first = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
        if len(first):
            h = np.add.reduceat(values[part] * pw[: len(part)], first) * un[first]
            starts.append(first + at)
            hashes.append(mix(h))
        at = end
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes of all windows of ``width`` adjacent word hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * powers(BASE, len(words)), dtype=np.uint64)))
    return mix((sums[width:] - sums[:-width]) * powers(UNBASE, n))


def joined(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """Texts with a line feed after each, and the start of each."""
    lens = np.array([len(t) + 1 for t in texts], np.int64)
    return b"\n".join(texts) + b"\n", np.concatenate(([0], np.cumsum(lens)[:-1]))
