"""Substring dedup: Rabin-Karp hashes of every fixed-length window of words, counted over the corpus.

Each window of ``width`` consecutive words has a 64-bit rolling hash. A block of documents sends
its distinct hashes to buckets, where the first block of each hash is found; a window is repeated if its
hash has an earlier block, or an earlier place in its own block. Repeated windows of a document
merge into maximal removal intervals of words.

Equality of windows is equality of 64-bit hashes: among N distinct windows some N^2 / 2^65 pairs
agree by chance (0.0005 pairs at 10^8 windows).

Defined cases: a null or blank text has no words and keeps nothing; texts shorter than a window lose
nothing; null ids count as one id after all others; of rows with one id, a window is earlier only by its
start; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress as select

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .blocks import ANSWER, KEYS, NO_ID, Layout, bucket_slices, compress, decode_sorted, encode_sorted, joined, per_block, per_bucket, window_hashes, word_hashes

RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("intervals", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("kept_text", pa.string())])
RESULT_SPARK = "doc_id long, n_words long, n_removed long, kept_sha256 string, intervals array<struct<start: int, end: int>>, kept_text string"


class Windows:
    """All windows of a block: ``hash``, ``doc`` and ``at`` (the first word's number in the block)."""

    def __init__(self, texts: list[bytes], width: int):
        data, starts = joined(texts)
        place, words = word_hashes(data)
        self.doc_of_word = np.searchsorted(starts, place, "right") - 1
        self.first_word = np.searchsorted(self.doc_of_word, np.arange(len(texts) + 1))
        h = window_hashes(words, width)
        inside = self.doc_of_word[: len(h)] == self.doc_of_word[width - 1 :] if len(h) else np.zeros(0, bool)
        self.at = np.flatnonzero(inside)
        self.hash = h[self.at]
        self.n_words = len(words)


def covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Flags of n words: inside some [start, start + width). The starts are distinct."""
    steps = np.zeros(n + 1, np.int32)
    steps[starts] += 1
    steps[starts + width] -= 1
    return np.cumsum(steps[:-1]) > 0


def remove_repeated_windows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 20, block_bytes: int = 4 << 20, bucket_bytes: int = 8 << 20, with_text: bool = False) -> DataFrame:
    """Per row: id, words, removed words, hash of the kept words, the removal ``intervals`` (word numbers,
    end exclusive) and, on request, ``kept_text`` (kept words joined by one space)."""
    layout = Layout(docs, id_col, text_col, block_bytes, bucket_bytes)
    buckets, rank_of, parts_of = layout.buckets, layout.rank, layout.parts

    def shared(block):
        """True for one of several blocks of an id."""
        return parts_of[rank_of[block]] > 1

    def least_starts(w, index, inverse):
        """The least start of each distinct window, all documents taken together."""
        start = w.at - w.first_word[w.doc_of_word[w.at]]
        least = start[index]
        np.minimum.at(least, inverse, start)
        return start, least

    def send(block, ids, texts, answers):
        w = Windows(texts, width)
        keys, index, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        starts = least_starts(w, index, inverse)[1].astype(np.uint32) if shared(block) else None
        for b, s, e in bucket_slices(keys, buckets):
            head = encode_sorted(keys[s:e])
            yield block, KEYS, b, None, None, len(head).to_bytes(8, "little") + head + (b"" if starts is None else compress(starts[s:e].tobytes()))

    def compare(bucket, blocks, bodies):
        sizes = [int.from_bytes(x[:8], "little") for x in bodies]
        parts = [decode_sorted(x[8 : 8 + n]) for x, n in zip(bodies, sizes, strict=True)]
        every = np.concatenate(parts)
        rank = np.repeat(rank_of[blocks], [len(p) for p in parts])
        order = np.argsort(every, kind="stable")  # equal keys stay in the order of their blocks
        ranked = every[order]
        new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
        number = np.cumsum(new) - 1
        first = np.empty(len(every), bool)
        first[order] = rank[order] == rank[order][new][number]
        least = None
        if any(shared(b) for b in blocks):  # the least start among the blocks of the first id
            start = np.concatenate([np.frombuffer(zstandard.ZstdDecompressor().decompress(x[8 + n :]), np.uint32) if shared(b) else np.zeros(len(p), np.uint32) for b, x, n, p in zip(blocks, bodies, sizes, parts, strict=True)])
            low = np.full(int(number[-1]) + 1 if len(number) else 0, 2**32 - 1, np.uint32)
            np.minimum.at(low, number, np.where(first[order], start[order], np.uint32(2**32 - 1)))
            least = np.empty(len(every), np.uint32)
            least[order] = low[number]
        at = 0
        for block, part in zip(blocks, parts, strict=True):
            body = len(part).to_bytes(8, "little") + np.packbits(first[at : at + len(part)]).tobytes()
            yield block, ANSWER, bucket, None, None, compress(body + (least[at : at + len(part)].tobytes() if shared(block) else b""))
            at += len(part)

    def finish(block, ids, texts, answers):
        w = Windows(texts, width)
        keys, index, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        counts = [int.from_bytes(a[:8], "little") for a in answers(ANSWER)]
        here = np.concatenate([np.unpackbits(np.frombuffer(a, np.uint8, (n + 7) // 8, 8), count=n) for a, n in zip(answers(ANSWER), counts, strict=True)] or [np.zeros(0, np.uint8)]).astype(bool)
        doc = w.doc_of_word[w.at]
        rank = np.concatenate(([0], np.cumsum(ids[1:] != ids[:-1])))
        place = (rank[doc] << 32) | (w.at - w.first_word[doc])
        least = place[index]
        if rank[-1] + 1 < len(ids):  # rows with one id: the order of rows is not that of places
            np.minimum.at(least, inverse, place)
        if shared(block):  # one id: only the start counts
            place = least_starts(w, index, inverse)[0]
            least = np.concatenate([np.frombuffer(a, np.uint32, n, 8 + (n + 7) // 8) for a, n in zip(answers(ANSWER), counts, strict=True)] or [np.zeros(0, np.uint32)]).astype(np.int64)
        gone = covered(w.n_words, w.at[~here[inverse] | (place > least[inverse])], width)
        del w.hash, keys, index, inverse, place
        for d, text in enumerate(texts):
            flags = gone[w.first_word[d] : w.first_word[d + 1]]
            words = text.split()
            n = int(flags.sum())
            if n:
                words = list(select(words, (~flags).tolist()))
            edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0])))) if n else []
            kept = b" ".join(words)
            spans = [{"start": int(a), "end": int(b)} for a, b in zip(edges[0::2], edges[1::2], strict=True)]
            yield None if ids[d] == NO_ID else int(ids[d]), len(flags), n, hashlib.sha256(kept).hexdigest(), spans, kept.decode() if with_text else None

    rows = layout.pack()
    answers = per_bucket(per_block(rows, send), compare)
    return layout.expanded(per_block(rows, finish, RESULT_SPARK, RESULT, answers, with_times=True))
