"""Suffix-array dedup of byte strings across documents.

A byte is removed if it is covered by a ``length``-byte string that also starts in a document with a smaller
id. Suffixes are sorted by hash comparison: prefix polynomial hashes and a binary search give
the common extension of two suffixes, so a comparison in the mergesort costs a logarithm of the length;
neighbours that agree are verified byte by byte. Sorting every suffix of a corpus in one array is
neither possible in one task nor needed, so the work is cut in three exchanges between blocks of documents
(``blocks``):

1. Every ``length``-byte string holds an anchor, its smallest ``seed``-byte string by hash (the same
   anchor in every copy). Blocks send each anchor's hash with the hash of its context, all bytes that strings around
   it can reach. A context with an earlier block settles all its strings. A string
   reaches over at least half of the context on one side of its anchor, so strings on a side whose half
   no other context of the anchor has are the only copies.
2. Only strings on a side that several contexts share stay open (the ends of shared passages). A block
   suffix-sorts its open strings per anchor and offset; equal neighbours form a class, and each class is sent once.
3. Buckets find the first block of each class, and the blocks finish their documents from the flags and open strings that
   the second pass kept for them; nothing is sorted twice.

A class is compared between blocks by a 64-bit hash with a 32-bit check; contexts by the anchor's hash and 48 bits more.

Defined cases: a null text is an empty text; texts shorter than ``length`` lose nothing; null ids count as
one id after all others; rows with one id remove nothing from each other; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import ANSWER, BASE, KEYS, LATER, NO_ID, STATE, UNBASE, Layout, bucket_slices, compress, decode_sorted, encode_sorted, joined, mix, per_block, per_bucket, powers

RESULT_COLUMNS = [("doc_id", pa.int64(), "long"), ("n_bytes", pa.int64(), "long"), ("n_removed", pa.int64(), "long"), ("n_spans", pa.int64(), "long"), ("kept_sha256", pa.string(), "string"), ("kept", pa.binary(), "binary")]
RESULT = pa.schema([(n, t) for n, t, _ in RESULT_COLUMNS])
RESULT_SPARK = ", ".join(f"{n} {s}" for n, _, s in RESULT_COLUMNS)
NO_SIDE = np.uint64(0xFFF)
#: A number per byte value, none of them even.
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * BASE) | np.uint64(1)


class Anchors:
    """Anchors of a block: hash ``key``, context hash ``ctx``, and the strings each stands for: starts
    ``first`` to ``first + count`` in the joined data."""

    def __init__(self, data: bytes, starts: np.ndarray, length: int, seed: int, chunk: int = 1 << 16):
        buf = np.frombuffer(data, np.uint8)
        ends = np.append(starts[1:], len(buf)) - 1  # without the line feed
        reach, out = length - seed, []
        for at in range(0, len(buf), chunk):
            lo, hi = max(0, at - reach), min(len(buf), at + chunk + reach + length)
            part = buf[lo:hi]
            n = min(chunk, len(buf) - at)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTES[part] * powers(BASE, len(part)), dtype=np.uint64)))
            un = powers(UNBASE, len(part) + 1)
            places = at - lo + np.arange(n)
            d = np.searchsorted(starts, at + np.arange(n), "right") - 1
            valid = places[at + np.arange(n) + length <= ends[d]]
            if not len(valid):
                continue
            top = len(part) - seed + 1
            h = mix((sums[seed : seed + top] - sums[:top]) * un[:top])
            low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(top, dtype=np.uint64)
            width, span = reach + 1, 1
            while span * 2 <= width:  # least of 1, 2, 4 ... neighbours
                low = np.minimum(low[:-span], low[span:])
                span *= 2
            low = np.minimum(low[valid], low[valid + width - span])
            anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
            new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1] + 1))))
            a, first = anchor[new], valid[new]
            own = d[first - (at - lo)]
            s, e = np.maximum(a - reach, starts[own] - lo), np.minimum(a + length, ends[own] - lo)
            ctx = mix(((sums[e] - sums[s]) * un[s]) ^ mix(((a - s) * 256 + (e - a)).astype(np.uint64)))
            half = (reach + 1) // 2

            def side(b, whole):
                """Twelve bits of the hash of half a context, or NO_SIDE at the text's end."""
                b = np.where(whole, b, a)
                return np.where(whole, mix((sums[b + half] - sums[b]) * un[b]) % NO_SIDE, NO_SIDE)

            left = side(a - half, a - half >= starts[own] - lo)
            right = side(a + seed, a + seed + half <= ends[own] - lo)
            ctx = (left << np.uint64(36)) | (right << np.uint64(24)) | (ctx >> np.uint64(40))
            # mixed: an anchor's hash is a minimum, and keys as small as minima would crowd into the first buckets
            out.append((mix(h[a]), ctx, first + lo, np.diff(np.append(new, len(valid))), own, a + lo))
        cols = list(zip(*out, strict=True)) if out else [[np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], *[[np.zeros(0, np.int64)]] * 4]
        self.key, self.ctx, self.first, self.count, self.doc, self.at = (np.concatenate(c) for c in cols)

    def entries(self, drop: int):
        """Distinct (key, ctx), ascending, and each anchor's entry."""
        key = self.key >> np.uint64(drop)
        order = np.lexsort((self.ctx, key))
        key, ctx = key[order], self.ctx[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (ctx[1:] != ctx[:-1])
        entry = np.empty(len(key), np.int64)
        entry[order] = np.cumsum(new) - 1
        return key[new], ctx[new], entry


# ---------------------------------------------------------------- suffix sort


def common_extension(hashes: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the common beginning of rows x and y, by binary search over their prefix hashes."""
    width = hashes.shape[1]
    flat, lo, hi = hashes.ravel(), np.zeros(len(x), np.int64), np.full(len(x), width - 1)
    for _ in range(int(width - 1).bit_length()):
        mid = (lo + hi + 1) >> 1
        same = flat[x * width + mid] == flat[y * width + mid]
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
    return lo


def sort_suffixes(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows (n by length bytes) by group and then by content, and whether each equals the one before.

    A bottom-up mergesort inside the groups, all merges of a level at once: an element's place is its
    place in its own run plus the number of elements of the other run that go before it.
    """
    n, length = rows.shape
    order = np.argsort(group, kind="stable")
    sums = np.zeros((n, length + 1), np.uint64)
    np.cumsum(BYTES[rows] * powers(BASE, length), axis=1, dtype=np.uint64, out=sums[:, 1:])
    g = group[order]
    begin = np.searchsorted(g, g)
    size = np.searchsorted(g, g, "right") - begin
    padded = np.concatenate((rows, np.zeros((n, 1), np.uint8)), 1)
    run = 1
    while n and run < size.max():
        move = np.flatnonzero(size > run)
        q = move - begin[move]
        side = q // run
        other = begin[move] + (side ^ 1) * run
        lo = np.zeros(len(move), np.int64)
        hi = np.clip(begin[move] + size[move] - other, 0, run)
        x = order[move]
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            i = np.flatnonzero(open_)
            y = order[other[i] + mid[i]]
            e = common_extension(sums, x[i], y)
            before = padded[y, e] < padded[x[i], e]
            before |= (e == length) & (side[i] % 2 == 1)  # equal ones of the left run stay before
            lo[i], hi[i] = np.where(before, mid[i] + 1, lo[i]), np.where(before, hi[i], mid[i])
        moved = order.copy()
        moved[begin[move] + (side // 2) * 2 * run + q % run + lo] = x
        order, run = moved, run * 2
    same = np.zeros(n, bool)
    if n > 1:
        same[1:] = (g[1:] == g[:-1]) & (common_extension(sums, order[1:], order[:-1]) == length)
        wrong = same[1:] & (rows[order[1:]] != rows[order[:-1]]).any(1)
        for k in np.unique(g[1:][wrong]):  # a hash collision: this group is sorted by its bytes
            at = np.flatnonzero(g == k)
            order[at] = sorted(order[at], key=lambda r: rows[r].tobytes())
            same[at[1:]] = [(rows[order[i]] == rows[order[i - 1]]).all() for i in at[1:]]
    return order, same


def string_classes(data: bytes, place: np.ndarray, group: np.ndarray, length: int, slab: int = 20_000):
    """Class numbers of the strings at ``place`` (equal strings are in one group), and each class's hash and check."""
    buf = np.frombuffer(data, np.uint8)
    cls, hashes, checks, at, classes = np.zeros(len(place), np.int64), [], [], 0, 0
    by_group = np.argsort(group, kind="stable")
    ranked = group[by_group]
    pw = powers(BASE, length)
    while at < len(place):
        end = min(len(place), at + slab)
        end = int(np.searchsorted(ranked, ranked[end - 1], "right"))  # whole groups
        own = by_group[at:end]
        rows = buf[place[own][:, None] + np.arange(length)]
        order, same = sort_suffixes(rows, group[own])
        cls[own[order]] = classes + np.cumsum(~same) - 1
        heads = rows[order[~same]]
        values = BYTES[heads]
        hashes.append(mix((values * pw).sum(1, dtype=np.uint64)))
        checks.append((mix((mix(values) * pw[::-1]).sum(1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32))
        classes += len(heads)
        at = end
    return cls, np.concatenate(hashes or [np.zeros(0, np.uint64)]), np.concatenate(checks or [np.zeros(0, np.uint32)])


# ---------------------------------------------------------------- the operator


def kept_state(repeated: np.ndarray, place: np.ndarray, cls: np.ndarray) -> bytes:
    """What ``state_of`` reads back: flags of the string starts; places, ascending, with their classes."""
    by = np.argsort(place)
    places = encode_sorted(place[by].astype(np.uint64))
    classes = np.ascontiguousarray(cls[by].astype(np.uint32).view(np.uint8).reshape(-1, 4).T)
    sizes = np.array([len(repeated), len(place), len(places)], np.int64)
    return compress(sizes.tobytes() + places + classes.tobytes() + np.packbits(repeated).tobytes())


def state_of(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    total, n, size = np.frombuffer(body, np.int64, 3).tolist()
    place = decode_sorted(body[24 : 24 + size])[:n].astype(np.int64)
    cls = np.ascontiguousarray(np.frombuffer(body, np.uint8, 4 * n, 24 + size).reshape(4, n).T).view(np.uint32).ravel().astype(np.int64)
    return np.unpackbits(np.frombuffer(body, np.uint8, offset=24 + size + 4 * n), count=total).astype(bool), place, cls


def finished(ids, texts: list[bytes], repeated: np.ndarray, length: int, with_kept: bool):
    """Result rows; ``repeated`` flags the string starts of the joined texts."""
    at = 0
    for d, text in enumerate(texts):
        n = len(text)
        starts = np.flatnonzero(repeated[at : at + n])
        at += n + 1
        removed = spans = 0
        kept = text
        if len(starts):
            steps = np.zeros(n + 1, np.int32)
            steps[starts] += 1
            steps[starts + length] -= 1
            gone = np.cumsum(steps[:-1]) > 0
            removed, spans = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        yield None if ids[d] == NO_ID else int(ids[d]), n, removed, spans, hashlib.sha256(kept).hexdigest(), kept if with_kept else None


def remove_repeated_strings(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 50, seed: int = 20, block_bytes: int = 2 << 20, bucket_bytes: int = 8 << 20, with_kept: bool = False,
) -> DataFrame:
    """Per row: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and, on request, the ``kept`` bytes."""
    layout = Layout(docs, id_col, text_col, block_bytes, bucket_bytes)
    buckets, rank_of = layout.buckets, layout.rank
    bits = min(64, max(40, int(layout.total).bit_length() + 12))
    drop = 64 - bits

    def send(block, ids, texts, answers):
        key, ctx, _ = Anchors(*joined(texts), length, seed).entries(drop)
        for b, s, e in bucket_slices(key, buckets, bits):
            planes = np.ascontiguousarray(ctx[s:e].view(np.uint8).reshape(-1, 8)[:, :6].T)
            head = encode_sorted(key[s:e])
            yield block, KEYS, b, None, None, len(head).to_bytes(8, "little") + head + planes.tobytes()

    def compare(bucket, blocks, bodies):
        keys, ctxs = [], []
        for x in bodies:
            n = int.from_bytes(x[:8], "little")
            keys.append(decode_sorted(x[8 : 8 + n]))
            c = np.zeros((len(keys[-1]), 8), np.uint8)
            c[:, :6] = np.frombuffer(x, np.uint8, offset=8 + n).reshape(6, -1).T
            ctxs.append(c.view(np.uint64).ravel())
        sizes = [len(k) for k in keys]
        key, ctx, rank = np.concatenate(keys), np.concatenate(ctxs), np.repeat(rank_of[blocks], sizes)
        order = np.lexsort((ctx, key))  # stable: equal entries stay in the order of their blocks
        k, c = key[order], ctx[order]
        new_key = np.concatenate(([True], k[1:] != k[:-1]))
        first = new_key | np.concatenate(([True], c[1:] != c[:-1]))
        head = np.maximum.accumulate(np.where(first, np.arange(len(k)), 0))
        earliest_rank = rank[order] == rank[order][head]  # all blocks of one id settle nothing for each other
        number = np.cumsum(new_key) - 1
        several = first & (np.bincount(number, first)[number] > 1)
        code = np.empty(len(k), np.uint8)  # 0 alone, 1 settled by an earlier block, 2 and 4 open to the left and right
        open_ = np.zeros(len(k), np.uint8)
        some = np.flatnonzero(several)
        for bit, half in ((2, c[some] >> np.uint64(36)), (4, (c[some] >> np.uint64(24)) & NO_SIDE)):
            by = np.lexsort((half, number[some]))
            n, v = number[some][by], half[by]
            group = np.cumsum(np.concatenate(([True], (n[1:] != n[:-1]) | (v[1:] != v[:-1])))) - 1 if len(by) else by
            shared = (np.bincount(group)[group] > 1) & (v != NO_SIDE) if len(by) else by
            open_[some[by]] |= np.where(shared, bit, 0).astype(np.uint8)
        code[order] = np.where(earliest_rank, open_[head], 1)
        at = 0
        for block, n in zip(blocks, sizes, strict=True):
            yield block, ANSWER, bucket, None, None, compress(code[at : at + n].tobytes())
            at += n

    def opened(ids, texts, codes):
        """Flags of the strings settled as repeated; the open strings' places, classes, and whether a smaller id of
        the block has the class; the classes' hashes and checks, ascending."""
        data, starts = joined(texts)
        a = Anchors(data, starts, length, seed)
        key, _, entry = a.entries(drop)
        rank = np.concatenate(([0], np.cumsum(ids[1:] != ids[:-1])))
        own = rank[a.doc]
        least = np.full(len(key), len(ids), np.int64)
        np.minimum.at(least, entry, own)
        code = np.frombuffer(b"".join(codes), np.uint8)[entry]
        settled = (code == 1) | (own > least[entry])
        repeated = np.zeros(len(data), bool)

        def strings(which):
            n = a.count[which]
            of = np.repeat(which, n)
            return of, a.first[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)

        repeated[strings(np.flatnonzero(settled))[1]] = True
        of, place = strings(np.flatnonzero(~settled & (code >= 2)))
        keep = code[of] & np.where(a.at[of] - place >= (length - seed + 1) // 2, 2, 4) > 0
        of, place = of[keep], place[keep]
        # a string's copies have the same anchor at the same offset
        _, group = np.unique((a.key[of] >> np.uint64(8) << np.uint64(8)) | (a.at[of] - place).astype(np.uint64), return_inverse=True)
        cls, hashes, checks = string_classes(data, place, group, length)
        by = np.lexsort((checks, hashes))
        renumber = np.empty(len(by), np.int64)
        renumber[by] = np.arange(len(by))
        cls, hashes, checks = renumber[cls], hashes[by], checks[by]
        low = np.full(len(hashes), len(ids), np.int64)
        np.minimum.at(low, cls, own[of])
        return repeated, place, cls, own[of] > low[cls], hashes, checks

    def send_open(block, ids, texts, answers):
        repeated, place, cls, later, hashes, checks = opened(ids, texts, answers(ANSWER))
        repeated[place[later]] = True
        yield block, STATE, -1 - block, None, None, kept_state(repeated, place[~later], cls[~later])
        for b, s, e in bucket_slices(hashes, buckets):
            head = encode_sorted(hashes[s:e])
            yield block, KEYS, b, None, None, len(head).to_bytes(8, "little") + head + checks[s:e].tobytes()

    def earliest(bucket, blocks, bodies):
        hashes, checks = [], []
        for x in bodies:
            n = int.from_bytes(x[:8], "little")
            hashes.append(decode_sorted(x[8 : 8 + n]))
            checks.append(np.frombuffer(x, np.uint32, offset=8 + n))
        h, c = np.concatenate(hashes), np.concatenate(checks)
        order = np.lexsort((c, h))
        new = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1])))
        rank = np.repeat(rank_of[blocks], [len(x) for x in hashes])[order]
        first = np.empty(len(h), bool)
        first[order] = rank == rank[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
        at = 0
        for block, part in zip(blocks, hashes, strict=True):
            yield block, LATER, bucket, None, None, compress(first[at : at + len(part)].tobytes())
            at += len(part)

    def finish(block, ids, texts, answers):
        repeated, place, cls = state_of(answers(STATE)[0])
        first = np.frombuffer(b"".join(answers(LATER)), bool)
        repeated[place[~first[cls]]] = True
        yield from finished(ids, texts, repeated, length, with_kept)

    # One plan: the texts are shuffled once and read three times; the open strings travel with the classes and come back with the answers.
    rows = layout.pack()
    codes = per_bucket(per_block(rows, send), compare)
    firsts = per_bucket(per_block(rows, send_open, answers=codes), earliest)
    return layout.expanded(per_block(rows, finish, RESULT_SPARK, RESULT, firsts, with_times=True))
