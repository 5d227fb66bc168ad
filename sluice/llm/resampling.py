"""Importance resampling towards a target distribution, with the cutoff found by selection.

Features of a text are its runs of one to ``width`` consecutive words, hashed to ``buckets`` by CRC-32. Steps:

1. Every task counts its rows' features in an array; the arrays of all tasks add up to the corpus and target counts.
   A bucket's gain is a thousand times the log ratio of its two smoothed shares, rounded down.
2. A second pass adds up the gains of each text (array look-ups) and a Gumbel number of its id, so that the
   highest scores are a draw without replacement with probabilities in proportion to exp(weight / 1000).
3. The last score that is drawn is found by selection, not by a sort of all scores: each chunk of a partition
   gives the median of its remaining keys, the median of these, weighted by the chunks' remaining sizes, is the
   pivot, and the keys on the wrong side of it, a quarter of them at least, are discarded. Survivors are
   written anew whenever they have shrunk to a quarter, so all rounds together read a small multiple of the keys.
   The driver holds one key per chunk of ``chunk_rows`` keys, and at the end ``base`` keys at most.
4. Only the winners are sorted, by range partitions.

CRC-32 of all features at once: a word's bytes are folded in by table look-ups over all words of a batch, and
the CRC of a run follows from those of its words, because appending n bytes is a linear map of 32 bits.

Defined cases: null or blank texts have no feature, weight 0, and are not drawn (under ``min_words`` words); null
ids count as the empty text in the Gumbel number and as the largest id in ties; rows with one id and one score are
separate candidates, in any but a fixed order; an empty target gives every bucket the gain of smoothing alone; an empty table gives
an empty result; columns other than the named ones are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import joined
from .common import col, slices, staged

LONGEST = 64  # words over this many bytes are hashed one by one
LAST = 2**63 - 1

#: Word bytes in lower case, others 0: digits, letters and all of multi-byte characters.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[:48] = FOLD[58:65] = FOLD[91:97] = FOLD[123:128] = 0


def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """The CRC-32 step per byte, and the map of appending 0 to LONGEST + 1 zero bytes, by the four bytes of a CRC."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, np.uint32(0xEDB88320) ^ (step >> np.uint32(1)), step >> np.uint32(1)).astype(np.uint32)
    shift = [(np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)]
    for _ in range(LONGEST + 1):
        shift.append(step[shift[-1] & np.uint32(255)] ^ (shift[-1] >> np.uint32(8)))
    return step, np.stack(shift)


STEP, SHIFT = _crc_tables()
FLAT = SHIFT.ravel()


def appended(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The map of n zero bytes (up to LONGEST + 1) on CRCs without their final complement."""
    at = n.astype(np.int64) << 10
    out = FLAT[at + (crc & np.uint32(255))]
    for k in (1, 2, 3):
        out ^= FLAT[at + (k << 8) + ((crc >> np.uint32(8 * k)) & np.uint32(255))]
    return out


def word_crcs(texts: list[bytes], chunk: int = 1 << 20) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The folded bytes, and each word's text, start, length and CRC-32."""
    data, starts = joined(texts)
    buf = FOLD[np.frombuffer(data, np.uint8)]
    inside = buf > 0
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    edges = np.concatenate(([0], edges)) if len(buf) and inside[0] else edges  # the last byte is a line feed, so edges come in pairs
    first, length = edges[0::2], edges[1::2] - edges[0::2]
    crc = np.zeros(len(first), np.uint32)
    for s in range(0, len(first), chunk):
        size = length[s : s + chunk]
        short = np.minimum(size, LONGEST + 1).astype(np.uint8)
        order = np.argsort(short, kind="stable")[::-1]
        longer = len(size) - np.cumsum(np.bincount(short, minlength=LONGEST + 2))
        at, c = first[s : s + chunk][order], np.full(len(size), 0xFFFFFFFF, np.uint32)
        for j in range(LONGEST):
            k = int(longer[j])
            if not k:
                break
            c[:k] = STEP[(c[:k] ^ buf[at[:k] + j]) & np.uint32(255)] ^ (c[:k] >> np.uint32(8))
        crc[s + order] = ~c
    folded = buf.tobytes()
    for i in np.flatnonzero(length > LONGEST).tolist():
        crc[i] = zlib.crc32(folded[first[i] : first[i] + length[i]])
    return folded, np.searchsorted(starts, first, "right") - 1, first, length, crc


def feature_buckets(texts: list[bytes], width: int, buckets: int):
    """For each run length: the text and the bucket of each run."""
    folded, doc, first, length, crc = word_crcs(texts)
    space = np.full(1, zlib.crc32(b" "), np.uint32)
    run = crc
    for n in range(1, width + 1):
        if n > 1:
            # crc(a + " " + b) from crc(a), crc(" ") and crc(b)
            tail, size = crc[n - 1 :], length[n - 1 :]
            plain = np.minimum(size, LONGEST)
            run = appended(run[: len(tail)], plain + 1) ^ appended(np.broadcast_to(space, plain.shape), plain) ^ tail
            beyond = np.flatnonzero(size > LONGEST)
            for i in beyond.tolist():
                run[i] = zlib.crc32(b" ".join(folded[first[k] : first[k] + length[k]] for k in range(i, i + n)))
        own = doc[: len(run)]
        whole = own == doc[n - 1 :] if len(run) else np.zeros(0, bool)
        yield own[whole], (run[whole] % np.uint32(buckets)).astype(np.int64)


def feature_counts(docs: DataFrame, text_col: str, width: int, buckets: int) -> DataFrame:
    """``bucket, n`` of all texts; buckets that do not occur are missing."""

    def count(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
                for _, at in feature_buckets(texts, width, buckets):
                    total += np.bincount(at, minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], ["bucket", "n"])

    return docs.select(col(docs, text_col).alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(share in the target / share in the corpus)) of each bucket, one more occurrence added everywhere."""
    n, own, all_ = len(corpus), float(target.sum() + len(target)), float(corpus.sum() + len(corpus))
    return np.array([math.floor(1000 * math.log((float(target[b]) + 1) * all_ / ((float(corpus[b]) + 1) * own))) for b in range(n)], np.int64)


def importance_scores(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", width: int = 3, buckets: int = 10_000, seed: int = 42) -> DataFrame:
    """Per row of ``docs``: ``row`` (a number), id, n_words, n_features, weight, score, text_md5."""
    both = feature_counts(docs, text_col, width, buckets).withColumn("side", F.lit(0)).unionByName(feature_counts(target, target_text_col, width, buckets).withColumn("side", F.lit(1)))
    counts = np.zeros((2, buckets), np.int64)
    for r in both.collect():  # 2 * buckets numbers
        counts[r["side"], r["bucket"]] = r["n"]
    gains = bucket_gains(counts[0], counts[1])

    def weigh(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
                weight, n, words = np.zeros(len(texts)), np.zeros(len(texts), np.int64), None
                for doc, at in feature_buckets(texts, width, buckets):
                    weight += np.bincount(doc, gains[at], len(texts))  # whole numbers under 2**53: exact
                    n += np.bincount(doc, minlength=len(texts))
                    words = n.copy() if words is None else words
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_md5"), pa.array(words), pa.array(n), pa.array(weight.astype(np.int64))], ["doc_id", "text_md5", "n_words", "n_features", "weight"])

    text = col(docs, text_col)
    three = docs.select(col(docs, id_col).cast("long").alias("doc_id"), F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("text_md5"), text.alias("text"))
    weighed = three.mapInArrow(weigh, "doc_id long, text_md5 string, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    return staged(weighed.withColumn("score", F.col("weight") + gumbel).withColumn("row", F.monotonically_increasing_id()), "resample-scores")


# ---------------------------------------------------------------- selection


def _before(a: np.ndarray, b: np.ndarray, c: np.ndarray, key: tuple) -> np.ndarray:
    return (a < key[0]) | ((a == key[0]) & ((b < key[1]) | ((b == key[1]) & (c < key[2]))))


def _median(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple:
    mid = (len(a) - 1) // 2
    v = np.partition(a, mid)[mid]
    tie = np.flatnonzero(a == v)
    i = tie[np.lexsort((c[tie], b[tie]))[mid - int((a < v).sum())]]
    return int(a[i]), int(b[i]), int(c[i])


def weighted_median(medians: list[tuple[int, tuple]]) -> tuple:
    """The key at half of the total weight, of (weight, key)."""
    medians = sorted(medians, key=lambda m: m[1])
    half, upto = sum(n for n, _ in medians) / 2, 0
    for n, key in medians:
        upto += n
        if upto >= half:
            return key
    raise ValueError("no keys")


def cutoff_key(keys: DataFrame, count: int, *, chunk_rows: int = 1 << 20, base: int = 4096) -> tuple | None:
    """The ``count``-th smallest (1 is the smallest) of ``keys``, whose rows are unique triples of longs (a, b, c)."""
    side = "n long, a long, b long, c long"
    schema = f"low struct<{side}>, high struct<{side}>"
    kind = pa.struct([(x, pa.int64()) for x in "nabc"])

    def part_medians(pivot):
        def work(batches):
            def found(parts):
                a, b, c = (np.concatenate([p[i] for p in parts]) for i in range(3))
                low = np.zeros(len(a), bool) if pivot is None else _before(a, b, c, pivot)
                high = ~low if pivot is None else ~low & ~((a == pivot[0]) & (b == pivot[1]) & (c == pivot[2]))
                out = []
                for m in (low, high):
                    n = int(m.sum())
                    out.append(dict(zip("nabc", (n, *(_median(a[m], b[m], c[m]) if n else (0, 0, 0))), strict=True)))
                return pa.RecordBatch.from_arrays([pa.array([x], kind) for x in out], ["low", "high"])

            parts, n = [], 0
            for batch in batches:
                parts.append([batch.column(x).to_numpy(zero_copy_only=False) for x in "abc"])
                n += batch.num_rows
                if n >= chunk_rows:
                    yield found(parts)
                    parts, n = [], 0
            if n:
                yield found(parts)

        return work

    def ordered(key, less: bool):
        a, b, c = (F.lit(x) for x in key)
        A, B, C = F.col("a"), F.col("b"), F.col("c")
        return (A < a) | ((A == a) & ((B < b) | ((B == b) & (C < c)))) if less else (A > a) | ((A == a) & ((B > b) | ((B == b) & (C > c))))

    rank, pivot, inside, held = count, None, keys, None
    while True:
        rows = inside.mapInArrow(part_medians(pivot), schema).collect()
        low, high = sum(r["low"]["n"] for r in rows), sum(r["high"]["n"] for r in rows)
        if pivot is None:
            if not 1 <= rank <= high:
                return None
            take, left, held = "high", high, high
        elif rank <= low:
            take, left, inside = "low", low, inside.where(ordered(pivot, True))
        elif rank == low + 1:
            return pivot
        else:
            take, left, inside, rank = "high", high, inside.where(ordered(pivot, False)), rank - low - 1
        if left <= base:
            return sorted((r["a"], r["b"], r["c"]) for r in inside.collect())[rank - 1]
        pivot = weighted_median([(r[take]["n"], (r[take]["a"], r[take]["b"], r[take]["c"])) for r in rows if r[take]["n"]])
        if 4 * left <= held:
            inside, held = staged(inside, "resample-keys"), left


def resample(docs: DataFrame, target: DataFrame, *, percent: int = 5, min_words: int = 20, id_col: str = "doc_id", text_col: str = "text", slot_rows: int = 1 << 20, chunk_rows: int = 1 << 20, base: int = 4096, **options) -> DataFrame:
    """``importance_scores`` with ``rank``: 1, 2, 3... of the drawn rows by falling score, then rising id; null for the others.
    Drawn are floor(percent * N / 100) of the N rows with at least ``min_words`` words."""
    scored = importance_scores(docs, target, id_col=id_col, text_col=text_col, **options)
    able = F.col("n_words") >= min_words
    drawn = percent * scored.where(able).count() // 100
    parts = (-F.col("score"), F.coalesce("doc_id", F.lit(LAST)), F.col("row"))
    key = cutoff_key(scored.where(able).select(*[p.alias(n) for p, n in zip(parts, "abc", strict=True)]), drawn, chunk_rows=chunk_rows, base=base) if drawn else None
    if key is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    a, b, c = parts
    wins = able & ((a < key[0]) | ((a == key[0]) & ((b < key[1]) | ((b == key[1]) & (c <= key[2])))))
    sort = (F.col("score").desc(), F.coalesce("doc_id", F.lit(LAST)), F.col("row"))
    winners = scored.where(wins).repartitionByRange(max(1, -(-drawn // slot_rows)), *sort).withColumn("slot", F.spark_partition_id())
    winners = staged(winners, "resample-winners")
    sizes = winners.groupBy("slot").agg(F.count("*").alias("in_slot"))
    before = sizes.select(F.col("slot").alias("s_slot"), F.coalesce(F.sum("in_slot").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = winners.join(before, F.col("slot") == F.col("s_slot")).withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("slot").orderBy(*sort)))
    return ranked.drop("slot", "s_slot", "before").unionByName(scored.where(~wins).withColumn("rank", F.lit(None).cast("long")))


def draw_documents(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The drawn rows of ``docs``. Rows with one id and text appear as often as they are drawn together."""
    result = resample(docs, target, id_col=id_col, text_col=text_col, **options)
    keys = result.groupBy(F.col("doc_id").alias("g_id"), F.col("text_md5").alias("g_md5")).agg(F.count("rank").cast("int").alias("_copies"), F.count("*").alias("_rows"))
    keys = staged(keys, "resample-copies")
    if not keys.where("_rows > 1 AND _copies > 0").isEmpty():
        docs = docs.dropDuplicates([id_col, text_col])
    taken = keys.where("_copies > 0").drop("_rows")
    same = col(docs, id_col).cast("long").eqNullSafe(taken["g_id"]) & (F.md5(F.coalesce(col(docs, text_col), F.lit("")).cast("binary")) == taken["g_md5"])
    row = F.struct(*[col(docs, c) for c in docs.columns]).alias("row")
    return docs.join(taken, same).select(row, F.explode(F.sequence(F.lit(1), taken["_copies"]))).select("row.*")
