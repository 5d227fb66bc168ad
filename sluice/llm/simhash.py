"""SimHash near-duplicates: pivot distance tables over fingerprints, and the components of their links.

A fingerprint has a bit set if more than half of the text's shingle hashes (XXH64 of the words joined by one space,
repeats included) have it set. Fingerprints link at ``bits`` or fewer differing bits. Steps:

1. Equal fingerprints become one node, so a group of exact copies is one node whatever its size.
2. Blocking: the 64 bits are cut into ``blocks`` parts; linked nodes agree in all bits of at least ``blocks - bits``
   of them, so the nodes are dealt to one bucket per choice of that many parts and value of their bits. The number of
   parts follows from the number of nodes, so that unrelated fingerprints share a bucket with few others.
3. In a bucket the distances of every node to ``pivots`` reference fingerprints are a table. Two linked nodes differ by
   ``bits`` at most in each coordinate (triangle inequality), so pairs are discarded coordinate by coordinate, and only
   the survivors are compared bit by bit. Pairs already in one group of the bucket are not looked at again.
4. A bucket of over ``piece`` nodes (a large group of near copies) is cut into pieces that all hold its hub, the node
   of most documents. Links become components; after that only the pairs of different pieces and
   different components are left: the nodes outside the bucket's largest component, in chunks, against every piece.
   So no link between components is lost, and no task holds a bucket.

The method alone (tables without blocking) compares all pairs of coordinates, which is quadratic in the corpus: distances to random
references concentrate around 32, so no single coordinate can deal nodes to small groups.

Defined cases: null, blank or wordless texts have fingerprint 0, which links like any other; texts with fewer words than a
shingle have one, their whole sequence; null ids count as one id after all others, and a component of null ids alone has
a null id; an empty table gives an empty result; columns other than the named ones are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import NO_ID, mix
from .common import IS_SPACE, col, slices, staged
from .jaccard import components, without

#: Bytes as they are, A-Z like a-z, spaces as one kind of space.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[IS_SPACE] = 32
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
LINKS_SPARK = "a long, b long"


def fingerprint(text: bytes, width: int = 4, seed: int = 42, chunk: int = 1 << 20) -> int:
    """The 64-bit SimHash of a text, from counts of its shingles' bits; ``chunk`` bytes are split into words at a time."""
    folded = text.translate(FOLD.tobytes())  # all six spaces are 32 now, which is where bytes.split() cuts
    digest, join = xxhash.xxh64_intdigest, b" ".join
    ones, n, at, words = np.zeros(64, np.int64), 0, 0, []

    def count(hashes: list[int]) -> np.ndarray:
        return np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)

    while at < len(folded):
        end = folded.find(b" ", at + chunk)
        end = len(folded) if end < 0 else end
        words += folded[at:end].split()
        at = end
        if len(words) >= width:
            new = [digest(join(words[i : i + width]), seed) for i in range(len(words) - width + 1)]
            ones, n, words = ones + count(new), n + len(new), words[len(new) :]
    if not n and words:  # fewer words than a shingle: the whole sequence
        ones, n = count([digest(join(words), seed)]), 1
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """Per row: id, ``fp`` (the 64 bits as a long) and text_md5."""

    def work(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                texts = part.column("text").cast(pa.binary()).to_pylist()
                fp = np.array([fingerprint(t or b"", width, seed) for t in texts], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp.view(np.int64)), part.column("text_md5")], ["doc_id", "fp", "text_md5"])

    text = col(docs, text_col)
    three = docs.select(col(docs, id_col).cast("long").alias("doc_id"), F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("text_md5"), text.alias("text"))
    return staged(three.mapInArrow(work, "doc_id long, fp long, text_md5 string"), "simhash-fingerprints")


# ---------------------------------------------------------------- pairs of a bucket


def references(pivots: int) -> np.ndarray:
    """Fixed pseudo-random reference fingerprints."""
    return mix(np.arange(1, pivots + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def distance_table(fp: np.ndarray, pivots: int) -> np.ndarray:
    """(pivot, node): Hamming distances to the references."""
    return np.stack([np.bitwise_count(fp ^ p) for p in references(pivots)]).astype(np.int8)


def survivors(i: np.ndarray, j: np.ndarray, fp: np.ndarray, table: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) within ``bits``: discarded coordinate by coordinate, then compared."""
    for row in table:
        if not len(i):
            break
        near = np.abs(row[i] - row[j]) <= bits
        i, j = i[near], j[near]
    near = np.bitwise_count(fp[i] ^ fp[j]) <= bits
    return i[near], j[near]


def grouped(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining the groups of each i and j: the least position of the group."""
    while True:
        a, b = label[i], label[j]
        if not (a != b).any():
            return label
        low, high = np.minimum(a, b), np.maximum(a, b)
        to = np.arange(len(label))
        np.minimum.at(to, high, low)
        while (to[to] != to).any():
            to = to[to]
        label = to[label]


def bucket_links(bucket: np.ndarray, fp: np.ndarray, bits: int, pivots: int, batch: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the linked groups of each bucket; nodes in the order of their buckets."""
    table, label = distance_table(fp, pivots), np.arange(len(fp))
    last, i = np.searchsorted(bucket, bucket, "right"), np.arange(len(fp))  # the end of each node's bucket
    for lag in range(1, int((last - i).max(initial=1))):
        i = i[last[i] > i + lag]
        for s in range(0, len(i), batch):
            one = i[s : s + batch]
            one = one[label[one] != label[one + lag]]
            a, b = survivors(one, one + lag, fp, table, bits)
            if len(a):
                label = grouped(label, a, b)
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return fp[label[moved]], fp[moved]


def cross_links(left: np.ndarray, left_comp: np.ndarray, right: np.ndarray, right_comp: np.ndarray, bits: int, pivots: int, batch: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Links between nodes of different components, one on each side; at most one per pair of components and batch."""
    fp, comp = np.concatenate((left, right)), np.concatenate((left_comp, right_comp))
    table, rows = distance_table(fp, pivots), max(1, batch // max(1, len(right)))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for s in range(0, len(left), rows):
        i = np.repeat(np.arange(s, min(len(left), s + rows)), len(right))
        j = np.tile(np.arange(len(left), len(fp)), len(i) // max(1, len(right)))
        other = comp[i] != comp[j]
        a, b = survivors(i[other], j[other], fp, table, bits)
        if len(a):
            _, one = np.unique(np.stack((comp[a], comp[b])), axis=1, return_index=True)
            found.append((fp[a[one]], fp[b[one]]))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


# ---------------------------------------------------------------- blocking


def part_count(nodes: int, bits: int, occupancy: int = 64) -> int:
    """Parts of the fingerprint: the fewest at which ``nodes`` unrelated fingerprints fill a bucket with ``occupancy`` at most."""
    for parts in range(bits + 1, 33):
        if nodes <= occupancy * 2 ** (64 * (parts - bits) // parts):
            return parts
    return 32


def bucket_masks(parts: int, bits: int) -> list[int]:
    """The bits of each choice of ``parts - bits`` parts."""
    from itertools import combinations

    edges = [64 * p // parts for p in range(parts + 1)]
    part = [((1 << edges[p + 1]) - 1) & ~((1 << edges[p]) - 1) for p in range(parts)]
    return [sum(part[p] for p in chosen) for chosen in combinations(range(parts), parts - bits)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _links(rows: DataFrame, work, rows_per_task: int, rows_in_all: int) -> DataFrame:
    """``work`` of groups of whole buckets; ``rows`` have ``cell``, a struct."""
    groups = max(1, -(-rows_in_all // rows_per_task))

    def run(table: pa.Table) -> pa.Table:
        pa.set_memory_pool(pa.system_memory_pool())
        a, b = work(table)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))}, LINKS)

    return rows.withColumn("_g", F.pmod(F.xxhash64("cell"), F.lit(groups))).withColumn("cell", F.xxhash64("cell")).groupBy("_g").applyInArrow(run, LINKS_SPARK)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64, copy=False)


def simhash_links(nodes: DataFrame, count: int, bits: int, pivots: int, piece: int, rows_per_task: int) -> tuple[DataFrame, DataFrame]:
    """(links inside pieces, the nodes of cut buckets): the first part of the join of ``nodes`` (fp, docs)."""
    masks = bucket_masks(part_count(count, bits), bits)
    cells: list[Column] = [F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("value")) for k, m in enumerate(masks)]
    dealt = nodes.select("fp", "docs", F.explode(F.array(*cells)).alias("cell"))
    sizes = dealt.groupBy("cell").agg(F.count("*").alias("size"), F.max(F.struct("docs", "fp"))["fp"].alias("hub"))
    large = staged(sizes.where(F.col("size") > piece).select(F.col("cell").alias("l_cell"), F.ceil(F.col("size") / piece).alias("pieces"), "hub"), "simhash-large")
    joined = dealt.join(large, F.col("cell") == F.col("l_cell"), "left")
    placed = joined.select("fp", "cell", F.coalesce(F.pmod(F.xxhash64("fp"), F.col("pieces")), F.lit(0)).alias("piece"), F.col("pieces").isNotNull().alias("cut"))
    hubs = large.select(F.col("hub").alias("fp"), F.col("l_cell").alias("cell"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"))
    pieces = placed.select("fp", F.struct("cell", "piece").alias("cell")).unionByName(hubs.select("fp", F.struct("cell", "piece").alias("cell")))

    def inside(table: pa.Table):
        cell, fp = _numbers(table, "cell"), _numbers(table, "fp").view(np.uint64)
        order = np.lexsort((fp, cell))
        return bucket_links(cell[order], fp[order], bits, pivots)

    return _links(pieces, inside, rows_per_task, count * len(masks)), placed.where("cut").select("fp", "cell", "piece")


def _rest_links(cut: DataFrame, comp: DataFrame, bits: int, pivots: int, piece: int, rows_per_task: int) -> DataFrame | None:
    """Links between pieces of cut buckets: the nodes outside a bucket's largest component against all of its pieces."""
    named = staged(cut.join(comp.select(F.col("node").alias("c_node"), "comp"), F.col("fp") == F.col("c_node")).select("fp", "cell", "piece", "comp"), "simhash-cut")
    main = named.groupBy("cell", "comp").agg(F.count("*").alias("n")).groupBy("cell").agg(F.max(F.struct("n", "comp"))["comp"].alias("main"), F.sum("n").alias("size"))
    main = main.select(F.col("cell").alias("m_cell"), "main", "size")
    outside = staged(named.join(main, (F.col("cell") == F.col("m_cell")) & (F.col("comp") != F.col("main"))).select("fp", "cell", "comp", "size"), "simhash-outside")
    if outside.isEmpty():
        return None
    chunks = outside.groupBy("cell").agg(F.count("*").alias("rest")).select(F.col("cell").alias("o_cell"), F.ceil(F.col("rest") / piece).alias("chunks"))
    chunks = staged(chunks, "simhash-chunks")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    left = named.join(chunks, F.col("cell") == F.col("o_cell")).select("fp", "comp", "cell", "piece", each(F.col("chunks")).alias("chunk"), F.lit(0).alias("side"))
    right = outside.join(chunks, F.col("cell") == F.col("o_cell")).select("fp", "comp", "cell", each(F.ceil(F.col("size") / piece)).alias("piece"), F.pmod(F.xxhash64("fp"), F.col("chunks")).alias("chunk"), F.lit(1).alias("side"))
    rows = staged(left.unionByName(right).select("fp", "comp", "side", F.struct("cell", "piece", "chunk").alias("cell")), "simhash-rest")

    def across(table: pa.Table):
        cell, side = _numbers(table, "cell"), _numbers(table, "side")
        order = np.lexsort((side, cell))
        cell, side = cell[order], side[order]
        fp, comp = _numbers(table, "fp").view(np.uint64)[order], _numbers(table, "comp")[order]
        found = [(np.zeros(0, np.uint64),) * 2]
        starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(cell)], strict=True):
            m = s + int(np.searchsorted(side[s:e], 1))
            found.append(cross_links(fp[s:m], comp[s:m], fp[m:e], comp[m:e], bits, pivots))
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])

    return _links(rows, across, rows_per_task, rows.count())


def simhash_components(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42, bits: int = 4, pivots: int = 24, piece: int = 2048, rows_per_task: int = 1 << 17,
) -> DataFrame:
    """Per row: id, ``fingerprint`` (16 hexadecimal digits), ``component_id`` (the smallest id that links reach), ``comp`` (the same
    for the rows of a component) and ``text_md5``."""
    rows = fingerprints(docs, id_col=id_col, text_col=text_col, width=width, seed=seed)
    nodes = staged(rows.groupBy("fp").agg(F.count("*").alias("docs"), F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("least")), "simhash-nodes")
    found, cut = simhash_links(nodes, nodes.count(), bits, pivots, piece, rows_per_task)
    names = nodes.select(F.col("fp").alias("node"))
    comp = components(names, found)
    rest = _rest_links(cut, comp, bits, pivots, piece, rows_per_task)
    if rest is not None:
        a, b = comp.select(F.col("node").alias("na"), F.col("comp").alias("ca")), comp.select(F.col("node").alias("nb"), F.col("comp").alias("cb"))
        between = rest.join(a, F.col("a") == F.col("na")).join(b, F.col("b") == F.col("nb")).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        upper = components(comp.select(F.col("comp").alias("node")).distinct(), between).select(F.col("node").alias("u"), F.col("comp").alias("to"))
        comp = staged(comp.join(upper, F.col("comp") == F.col("u")).select("node", F.col("to").alias("comp")), "simhash-components")
    least = nodes.join(comp, F.col("fp") == F.col("node")).select("fp", "comp", "least")
    smallest = least.groupBy("comp").agg(F.min("least").alias("of_comp")).withColumnRenamed("comp", "s_comp")
    by_node = least.join(smallest, F.col("comp") == F.col("s_comp")).select(F.col("fp").alias("n_fp"), "comp", F.when(F.col("of_comp") != NO_ID, F.col("of_comp")).alias("of_comp"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(by_node, F.col("fp") == F.col("n_fp")).select("doc_id", hexed.alias("fingerprint"), F.col("of_comp").alias("component_id"), "comp", "text_md5")


def drop_simhash_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, one of each component: the smallest id, then the smallest text hash. Wordless texts are one component."""
    found = staged(simhash_components(docs, id_col=id_col, text_col=text_col, **options), "simhash-classes")
    stays = found.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_md5")).alias("w"))
    keys = stays.select(F.col("w.doc_id").alias("g_id"), F.col("w.text_md5").alias("g_md5"))
    kept, repeats = without(docs, keys, id_col, text_col, "left_semi"), found.groupBy("doc_id", "text_md5").count().where("count > 1")
    return kept if repeats.isEmpty() else kept.dropDuplicates([id_col, text_col])
