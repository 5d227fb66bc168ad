"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents are tokenized whole; those longer than a sequence are cut into full pieces behind a shorter
first one. Full pieces are sequences already. The shorter ones are dealt at random to shards of about
``shard_pieces``, and each shard is packed by several islands with different seeds. A
chromosome is a list of bins. Crossover injects the well-filled bins of one parent into
another, drops the bins that then hold a piece twice, and puts the displaced pieces back by best
fit, largest first. After the first epoch each island receives the elite of the
next island of its shard; the best chromosome after the last epoch wins. Bins filled to
``well_filled`` are final, the pieces of all others are dealt anew in the next round,
to fewer shards, so that half-empty bins do not add up over the shards. A shard stops early
when it has as few bins as its total size allows.

Defined cases: a null text is an empty text: one piece of one token, the end token; repeated rows are
packed separately; null ids are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, lean, slices, staged, trim


class Tokenizer:
    """Byte-level BPE ids of whole texts. Pre-tokens never span a space between two other characters, so
    a batch is split there. Distinct parts are encoded once, all new ones of a batch in one text, and up to ``keep`` of them
    are kept for later batches."""

    def __init__(self, ranks_path: str, pattern: str, keep: int = 1 << 19):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("documents", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)  # bytes of each token
        self.width[list(ranks.values())] = [len(token) for token in ranks]
        self.keep = keep
        self.forget()

    def forget(self) -> None:
        self.known, self.ids, self.ends = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def learn(self, parts: pa.Array) -> None:
        """The ids of each part as after a space: a token ends where a part ends, so widths tell the parts apart."""
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(parts)], pa.int32()), parts), " ")[0].as_py()
        ids = self.encoding.encode_to_numpy(" " + text).astype(np.uint32)
        stops = np.cumsum(pc.binary_length(parts).to_numpy().astype(np.int64) + 1)
        ends = np.searchsorted(np.cumsum(self.width[ids]), stops) + 1
        self.known = pa.concat_arrays([self.known, parts])
        self.ends = np.concatenate((self.ends, ends + len(self.ids)))
        self.ids = np.concatenate((self.ids, ids))

    def batch(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one document after the other, each closed by ``end``; and where each document starts."""
        lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        parts = lists.flatten().dictionary_encode()
        index, names = parts.indices.to_numpy(), parts.dictionary
        bare = pc.utf8_trim_whitespace(names)
        odd = pc.or_(pc.equal(bare, ""), pc.not_equal(bare, names)).to_numpy(zero_copy_only=False).astype(bool)
        if len(self.known) > self.keep:
            self.forget()
        place = pc.fill_null(pc.index_in(names, value_set=self.known), -1).to_numpy().astype(np.int64)
        new = (place < 0) & ~odd
        if new.any():
            place[new] = len(self.known) + np.arange(int(new.sum()))
            self.learn(names.filter(pa.array(new)))
        n = len(texts)
        whole = np.zeros(n, bool)
        if odd.any() and len(index):
            whole = np.add.reduceat(odd[index].astype(np.int64), offsets[:-1]) > 0
        # each document's first part has no space before it; a text with other space runs is one part
        index, keep = place[index], np.ones(len(index), bool)
        own = []
        for d in range(n):
            s, e = offsets[d], offsets[d + 1]
            index[s] = len(self.ends) + d
            text = texts[d].as_py()
            own.append(self.encoding.encode_to_numpy(text if whole[d] else text.split(" ", 1)[0]).astype(np.uint32))
            if whole[d]:
                keep[s + 1 : e] = False
        own.append(np.array([end], np.uint32))
        stops = np.concatenate((self.ends, len(self.ids) + np.cumsum([len(x) for x in own])))
        flat = np.concatenate((self.ids, *own))
        at = np.concatenate(([0], stops[:-1]))
        kept = np.concatenate(([0], np.cumsum(keep)))
        ends = kept[offsets[1:]]
        index = np.insert(index[keep], ends, len(stops) - 1)
        size = stops[index] - at[index]
        stop = np.cumsum(size)
        ids = flat[np.repeat(at[index] - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)]
        closes = ends + np.arange(n)
        return ids, np.concatenate(([0], stop[closes]))


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))])


def cut_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, pattern: str | None = None, capacity: int = 1024, end: int = 2, with_ids: bool = False) -> DataFrame:
    """Pieces of each document: id, piece, start, length, crc32 of the ids and, on request, the ids.

    The tokenizer is a file of ranks and its split pattern; by default those of the public 50k byte-level BPE,
    found by each task on its own machine.
    """

    def cut(batches):
        lean()
        path, split = ranks_path, pattern
        if path is None:
            import public_tokenizers

            path, split = str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN
        tokenizer = None
        for batch in batches:
            tokenizer = tokenizer or Tokenizer(path, split)
            for part in slices(batch, "text", 4 << 20):
                ids, at = tokenizer.batch(pc.fill_null(part.column("text"), ""), end)
                names = part.column("doc_id").to_pylist()
                out: list[list] = [[] for _ in PIECES]
                for d, name in enumerate(names):
                    s, e = int(at[d]), int(at[d + 1])
                    first = (e - s) % capacity or capacity
                    cuts = [s, *range(s + first, e + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        row = (name, k, a - s, b - a, zlib.crc32(ids[a:b].tobytes()), ids[a:b].tolist() if with_ids else None)
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, PIECES, strict=True)], schema=PIECES)
        tokenizer = None
        trim()

    two = docs.select(col(docs, id_col).cast("long").alias("doc_id"), col(docs, text_col).alias("text"))
    return two.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>")


# ---------------------------------------------------------------- grouping genetic algorithm


def best_fit(bins: list[list[int]], room: list[int], items, size: list[int], capacity: int) -> None:
    """Put each item into the open bin it fills best. Bins by their room; a bit set finds the least room that fits."""
    by_room: dict[int, list[int]] = {}
    bits = 0
    for b, r in enumerate(room):
        if r:
            by_room.setdefault(r, []).append(b)
            bits |= 1 << r
    for i in items:
        s = size[i]
        fits = bits >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            own = by_room[r]
            b = own.pop()
            if not own:
                bits &= ~(1 << r)
        else:
            b, r = len(bins), capacity
            bins.append([])
            room.append(capacity)
        bins[b].append(i)
        room[b] = left = r - s
        if left:
            by_room.setdefault(left, []).append(b)
            bits |= 1 << left


class Island:
    """A population of chromosomes over one shard's pieces. A chromosome is its bins and the room left in each."""

    def __init__(self, size: list[int], capacity: int, seed: int, population: int):
        self.size, self.capacity, self.random, self.population = size, capacity, random.Random(seed), population
        self.least = -(-sum(size) // capacity)
        self.members: list[tuple[list[list[int]], list[int]]] = []

    def take(self, bins: list[list[int]]) -> None:
        """A chromosome from elsewhere."""
        self.members.append((bins, [self.capacity - sum(self.size[i] for i in b) for b in bins]))

    def fitness(self, member) -> tuple[int, float]:
        """Fewer bins, then fuller ones (the sum of squared fills)."""
        capacity = self.capacity
        return len(member[0]), -sum([(capacity - r) ** 2 for r in member[1]])

    def start(self) -> None:
        items = list(range(len(self.size)))
        for k in range(self.population):
            # largest first, exactly at first, then with some noise
            order = sorted(items, key=lambda i: -self.size[i] * (1 if k == 0 else self.random.uniform(0.8, 1.0)))
            bins, room = [], []
            best_fit(bins, room, order, self.size, self.capacity)
            self.members.append((bins, room))
            if len(bins) <= self.least:
                break

    def done(self) -> bool:
        return min((len(bins) for bins, _ in self.members), default=0) <= self.least

    def cross(self, base, donor):
        """Whole well-filled bins of the donor enter the base."""
        size, most = self.size, self.capacity - 0.99 * self.capacity
        full = [k for k, r in enumerate(donor[1]) if r <= most]
        entered = self.random.sample(full, max(1, len(full) // 2)) if full else range(min(1, len(donor[0])))
        bins, room = [list(donor[0][k]) for k in entered], [donor[1][k] for k in entered]
        twice, displaced = {i for b in bins for i in b}, []
        for b, r in zip(*base, strict=True):
            if not twice.isdisjoint(b):
                displaced += [i for i in b if i not in twice]
            elif self.random.random() > 0.05:  # a few bins are broken up as mutation
                bins.append(list(b))
                room.append(r)
            else:
                displaced += b
        displaced.sort(key=lambda i: -size[i])
        best_fit(bins, room, displaced, size, self.capacity)
        return bins, room

    def evolve(self, generations: int) -> None:
        for _ in range(generations):
            if self.done():
                return
            parents = sorted(self.members, key=self.fitness)
            children = [self.cross(*self.random.sample(parents, 2)) for _ in range(self.population)] if len(parents) > 1 else []
            self.members = sorted(parents + children, key=self.fitness)[: self.population]

    def elite(self) -> list[list[int]]:
        return min(self.members, key=self.fitness)[0]


def pack_bins(bins: list[list[int]], n: int) -> bytes:
    out = np.zeros(n, np.int32)
    for k, b in enumerate(bins):
        out[b] = k
    return out.tobytes()


def open_bins(data: bytes) -> list[list[int]]:
    of = np.frombuffer(data, np.int32)
    order = np.argsort(of, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(of[order])) + 1)] if len(of) else []


def _epoch(rows: DataFrame, capacity: int, population: int, generations: int) -> DataFrame:
    """One epoch of each (shard, island) row: ``uids``, ``sizes`` and the ``members`` so far -> the same, evolved."""

    def run(batches):
        lean()
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                size = np.frombuffer(r["sizes"], np.int64).tolist()
                island = Island(size, capacity, r["shard"] * 1000 + r["island"] * 10 + len(r["members"] or []), population)
                for m in r["members"] or []:
                    island.take(open_bins(m))
                if not island.members:
                    island.start()
                island.evolve(generations)
                ranked = sorted(island.members, key=island.fitness)
                out.append((r["shard"], r["island"], r["uids"], r["sizes"], [pack_bins(m, len(size)) for m, _ in ranked], len(ranked[0][0]), float(island.fitness(ranked[0])[1])))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.int32(), pa.float64()), strict=True)], names=["shard", "island", "uids", "sizes", "members", "bins", "spread"])

    return rows.mapInArrow(run, "shard long, island int, uids binary, sizes binary, members array<binary>, bins int, spread double")


def _round(pieces: DataFrame, number: int, capacity: int, shard_pieces: int, islands: int, population: int, generations: int) -> DataFrame:
    """Pack (uid, length): per piece its bin ``sequence_id``, ``offset`` and the bin's ``fill``."""
    shards = max(1, -(-pieces.count() // shard_pieces))

    def gather(table: pa.Table) -> pa.Table:
        uids, sizes = table.column("uid").to_numpy(), table.column("length").to_numpy()
        order = np.argsort(uids, kind="stable")
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int64()), "uids": pa.array([uids[order].tobytes()], pa.binary()), "sizes": pa.array([sizes[order].tobytes()], pa.binary())})

    dealt = pieces.select("uid", "length", F.pmod(F.xxhash64("uid", F.lit(number)), F.lit(shards)).alias("shard"))
    rows = staged(dealt.groupBy("shard").applyInArrow(gather, "shard long, uids binary, sizes binary"), "pack-shards")
    start = rows.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "uids", "sizes", F.lit(None).cast("array<binary>").alias("members"))
    tasks = max(1, min(shards * islands, 4 * pieces.sparkSession.sparkContext.defaultParallelism * max(1, shards // 64)))
    first = staged(_epoch(start.repartition(tasks, "shard", "island"), capacity, population, generations), "pack-epoch")
    # migration: the elite of the next island joins the population
    elite = first.select(F.col("shard").alias("e_shard"), F.pmod(F.col("island") - 1, F.lit(islands)).alias("e_island"), F.col("members")[0].alias("elite"))
    second = first.join(elite, (F.col("shard") == F.col("e_shard")) & (F.col("island") == F.col("e_island"))).select("shard", "island", "uids", "sizes", F.concat("members", F.array("elite")).alias("members"))
    last = _epoch(second.repartition(tasks, "shard", "island"), capacity, population, generations)
    best = last.groupBy("shard").agg(F.min_by(F.struct("uids", "sizes", F.col("members")[0].alias("bins")), F.struct("bins", "spread", "island")).alias("best"))

    def place(batches):
        for batch in batches:
            for r in batch.to_pylist():
                b = r["best"]
                uids, sizes, of = np.frombuffer(b["uids"], np.int64), np.frombuffer(b["sizes"], np.int64), np.frombuffer(b["bins"], np.int32).astype(np.int64)
                order = np.argsort(of, kind="stable")
                uids, sizes, of = uids[order], sizes[order], of[order]
                stop = np.cumsum(sizes)
                first_of = np.searchsorted(of, of)
                offset = stop - sizes - (stop - sizes)[first_of]
                fill = np.bincount(of, sizes).astype(np.int64)[of]
                seq = ((number << 57) | (r["shard"] << 24)) + of
                yield pa.RecordBatch.from_arrays([pa.array(uids), pa.array(seq), pa.array(offset), pa.array(fill), pa.array(sizes)], names=["uid", "sequence_id", "offset", "fill", "length"])

    return staged(best.mapInArrow(place, "uid long, sequence_id long, offset long, fill long, length long"), "pack-placed")


def pack_pieces(pieces: DataFrame, *, capacity: int = 1024, shard_pieces: int = 2048, islands: int = 2, population: int = 4, generations: int = 6, well_filled: float = 0.995, rounds: int = 3) -> DataFrame:
    """(uid, length) of all pieces -> (uid, sequence_id, offset). Full pieces get negative sequence ids."""
    full = pieces.where(F.col("length") >= capacity).select("uid", (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    done, pool = [full], pieces.where(F.col("length") < capacity).select("uid", "length")
    for number in range(1, rounds + 1):
        placed = _round(pool, number, capacity, shard_pieces, islands, population, generations)
        final = F.lit(True) if number == rounds else F.col("fill") >= well_filled * capacity
        done.append(placed.where(final).select("uid", "sequence_id", "offset"))
        pool = placed.where(~final).select("uid", "length")
        if number < rounds and pool.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, with_ids: bool = False, ranks_path: str | None = None, pattern: str | None = None, end: int = 2, **options) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and the ids on request)."""
    pieces = cut_documents(docs, id_col=id_col, text_col=text_col, capacity=capacity, with_ids=with_ids, ranks_path=ranks_path, pattern=pattern, end=end)
    pieces = staged(pieces.withColumn("uid", F.monotonically_increasing_id()), "pack-pieces")
    placed = pack_pieces(pieces.select("uid", "length"), capacity=capacity, **options).withColumnRenamed("uid", "p_uid")
    return pieces.join(placed, F.col("uid") == F.col("p_uid")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))
