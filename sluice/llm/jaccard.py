"""N-gram Jaccard join: blocked products of the document by n-gram incidence matrix.

Documents link when the Jaccard similarity of their shingle sets reaches ``percent`` / 100; the result is
each document's connected component. Steps:

1. Count each shingle's documents through block and bucket exchange (``blocks``), exactly over the corpus
   up to the chance equality of 40-bit hashes, which only affects an ordering.
2. Order a document's shingles by rising count. Linked documents share one of the first
   |A| - ceil(t |A|) + 1 shingles of each in that order, so only those that occur elsewhere are posted; a
   shingle that a third of all documents hold stands last and is rarely posted. Equal sets become
   one node (a 128-bit hash of the set).
3. Each node joins the cluster of one hub, the node it shares most postings with among the smallest
   and the largest node of its postings. A cluster, in pieces of at most ``piece`` nodes that all hold the hub,
   is multiplied as an incidence matrix with its transpose, in blocks of shingles: the accumulated counts are the
   overlaps, and pairs under the size bounds are discarded. Links become components; then a
   second round, with hubs outside a node's own component.
4. What is left, pairs of nodes with a common posting in different components and inside the bounds, is
   verified pair by pair. So no pair is lost, and none is emitted inside a component. The bounds: with p
   shingles before its first common one, a set of n can share n - p at most, which limits its partner's
   size (``reach``); a linked pair meets this, both ways, at its first common shingle.

Components come from repeated contraction to the smallest neighbour, staged in the shared folder.

Defined cases: null or blank texts have no shingle and link with nothing (each is its own
component, even if repeated); texts with fewer words than a shingle have one, their whole
sequence; null ids count as one id after all others and get a null component id only if no real id is
reachable; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import ANSWER, KEYS, NO_ID, Layout, bucket_slices, compress, decode_sorted, encode_sorted, joined, per_block, per_bucket, window_hashes, word_hashes
from .common import col, staged, trim

KEY_BITS = 40
MEASURED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.binary()), ("first", pa.bool_()), ("shared", pa.binary()), ("posted", pa.list_(pa.int64())), ("text_md5", pa.string())])
MEASURED_SPARK = "doc_id long, n_shingles long, node binary, first boolean, shared binary, posted array<long>, text_md5 string"


def shingles(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each document's distinct shingles, by document, then hash."""
    data, starts = joined(texts)
    place, words = word_hashes(data, lower=True)
    doc = np.searchsorted(starts, place, "right") - 1
    h = window_hashes(words, width)
    inside = doc[: len(h)] == doc[width - 1 :] if len(h) else np.zeros(0, bool)
    docs, keys = [doc[: len(h)][inside]], [h[inside]]
    n_words = np.bincount(doc, minlength=len(texts))
    first = np.concatenate(([0], np.cumsum(n_words)))
    for n in range(1, width):  # whole sequences of short texts
        short = np.flatnonzero(n_words == n)
        if len(short):
            own = np.zeros(len(short), np.uint64)
            for j in range(n):
                own = (own + words[first[short] + j]) * np.uint64(0xD6E8FEB86659FD93 + 2 * n)
            docs.append(short), keys.append(own)
    doc, key = np.concatenate(docs), np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    doc, key = doc[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], key[new]


def prefix_length(n: int, percent: int) -> int:
    """A linked partner shares one of this many shingles, in any common order."""
    return n - -(-percent * n // 100) + 1


def measure(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, block_bytes: int, bucket_bytes: int) -> tuple[Layout, DataFrame]:
    """Per document: its number of shingles and, if one of its first shingles occurs elsewhere, its node,
    the shingles it shares with others (sorted 64-bit numbers) and its postings (once per block and node)."""
    layout = Layout(docs, id_col, text_col, block_bytes, bucket_bytes)
    buckets, drop = layout.buckets, np.uint64(64 - KEY_BITS)

    def send(block, ids, texts, answers):
        keys, counts = np.unique(shingles(texts, width)[1] >> drop, return_counts=True)
        for b, s, e in bucket_slices(keys, buckets, KEY_BITS):
            yield block, KEYS, b, None, compress(np.minimum(counts[s:e], 255).astype(np.uint8).tobytes()), encode_sorted(keys[s:e])

    def count(bucket, blocks, bodies):
        parts = [decode_sorted(x[1]) for x in bodies]
        every, counts = np.concatenate(parts), np.concatenate([x[0] for x in bodies])
        _, inverse = np.unique(every, return_inverse=True)
        total = np.bincount(inverse, counts)[inverse]
        # 1 for a lone shingle; above, a rising code: exact to 15, then eight steps for each doubling
        code = np.where(total < 16, total, np.minimum(255, 16 + np.floor(8 * np.log2(np.maximum(total, 16) / 16)))).astype(np.uint8)
        at = 0
        for block, part in zip(blocks, parts, strict=True):
            yield block, ANSWER, bucket, None, None, compress(code[at : at + len(part)].tobytes())
            at += len(part)

    def finish(block, ids, texts, answers):
        doc, key = shingles(texts, width)
        keys, inverse = np.unique(key >> drop, return_inverse=True)
        code = np.frombuffer(b"".join(answers(ANSWER)), np.uint8)[inverse]
        at = np.searchsorted(doc, np.arange(len(texts) + 1))
        seen = set()
        for d in range(len(texts)):
            s, e = int(at[d]), int(at[d + 1])
            n, own, rank = e - s, key[s:e], code[s:e]
            row, text = None if ids[d] == NO_ID else int(ids[d]), hashlib.md5(texts[d]).hexdigest()
            shared = own[rank > 1]
            # the lone shingles stand first in the order
            if n == 0 or n - len(shared) >= prefix_length(n, percent):
                yield row, n, None, False, None, None, text
                continue
            node = hashlib.md5(own.tobytes()).digest()
            if node in seen:
                yield row, n, node, False, None, None, text
                continue
            seen.add(node)
            order = np.lexsort((own, rank))[: prefix_length(n, percent)]
            posted = own[order][rank[order] > 1]
            yield row, n, node, True, shared.tobytes(), posted.view(np.int64).tolist(), text

    rows = layout.pack()
    sent = per_block(rows, send)
    answers = per_bucket_with_counts(sent, count)
    return layout, staged(per_block(rows, finish, MEASURED_SPARK, MEASURED, answers, with_times=True), "jaccard-measured")


def per_bucket_with_counts(sent: DataFrame, work) -> DataFrame:
    """``per_bucket`` whose bodies are (counts, keys)."""
    both = sent.withColumn("body", F.concat(F.lpad(F.octet_length("lens").cast("string"), 12, "0").cast("binary"), F.col("lens"), F.col("body")))

    def opened(bucket, blocks, bodies):
        pairs = []
        for x in bodies:
            n = int(x[:12])
            pairs.append((np.frombuffer(zstandard.ZstdDecompressor().decompress(x[12 : 12 + n]), np.uint8).astype(np.float64), x[12 + n :]))
        yield from work(bucket, blocks, pairs)

    return per_bucket(both, opened)


# ---------------------------------------------------------------- links inside clusters

LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def cluster_links(names: list[bytes], sizes: np.ndarray, sets: list[np.ndarray], percent: int, columns: int = 4096):
    """Pairs that span the linked groups of a cluster: the incidence matrix by its transpose, by blocks of columns."""
    m = len(names)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = times[column] > 1
    order = np.argsort(column[keep], kind="stable")
    row, column = row[keep][order], (np.cumsum(times > 1) - 1)[column[keep][order]]
    overlap = np.zeros((m, m), np.float32)
    width = int(column[-1]) + 1 if len(column) else 0
    for c in range(0, width, columns):
        s, e = np.searchsorted(column, [c, c + columns])
        part = np.zeros((m, min(columns, width - c)), np.float32)
        part[row[s:e], column[s:e] - c] = 1
        overlap += part @ part.T  # counts under 2**24 are exact
    total = sizes[:, None] + sizes[None, :]
    linked = 100 * overlap.astype(np.int64) >= percent * (total - overlap.astype(np.int64))
    group = np.full(m, -1)
    for i in range(m):  # a breadth-first tree of each linked group
        if group[i] < 0:
            group[i], front = i, [i]
            while front:
                x = front.pop()
                for y in np.flatnonzero(linked[x] & (group < 0)).tolist():
                    group[y] = i
                    front.append(y)
                    yield names[x], names[y]


def _linked(clusters: DataFrame, percent: int, groups: int) -> DataFrame:
    """Links of rows (cluster, node, n, shared); many clusters share a task's group."""

    def run(table: pa.Table) -> pa.Table:
        out: list[tuple] = []
        rows = sorted(table.select(["cluster", "node", "n", "shared"]).to_pylist(), key=lambda r: (r["cluster"], r["node"]))
        at = 0
        while at < len(rows):
            end = at
            while end < len(rows) and rows[end]["cluster"] == rows[at]["cluster"]:
                end += 1
            own = rows[at:end]
            if len(own) > 1:
                out += cluster_links([r["node"] for r in own], np.array([r["n"] for r in own], np.int64), [np.frombuffer(r["shared"], np.uint64) for r in own], percent)
            at = end
        done = pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([y for _, y in out], pa.binary())}, LINKS)
        del rows, out
        trim()
        return done

    return clusters.withColumn("_g", F.pmod(F.xxhash64("cluster"), F.lit(groups))).groupBy("_g").applyInArrow(run, "a binary, b binary")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node that links reach. Edges are contracted until none is left."""
    comp = staged(nodes.select("node", F.col("node").alias("comp")), "jaccard-components")
    edges = staged(links.select("a", "b").where("a <> b").distinct(), "jaccard-links")
    while not edges.isEmpty():
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = near.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to"))
        # one jump along the chain of smaller neighbours halves it
        hop = step.select(F.col("a").alias("h"), F.col("to").alias("hop"))
        step = staged(step.join(hop, F.col("to") == F.col("h"), "left").select("a", F.coalesce("hop", "to").alias("to")), "jaccard-steps")
        comp = staged(comp.join(step, F.col("comp") == F.col("a"), "left").select("node", F.coalesce("to", "comp").alias("comp")), "jaccard-components")
        left, right = step.select(F.col("a").alias("la"), F.col("to").alias("lt")), step.select(F.col("a").alias("ra"), F.col("to").alias("rt"))
        moved = edges.join(left, F.col("a") == F.col("la"), "left").join(right, F.col("b") == F.col("ra"), "left")
        edges = staged(moved.select(F.coalesce("lt", "a").alias("a"), F.coalesce("rt", "b").alias("b")).where("a <> b").distinct(), "jaccard-links")
    return comp


def jaccard_components(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75, piece: int = 512, block_bytes: int = 4 << 20, bucket_bytes: int = 8 << 20,
) -> DataFrame:
    """Per row: id, ``n_shingles`` and ``component_id``, the smallest id that links reach; ``class_key``, the same for
    the rows of a component and null for rows that cannot have a link; ``text_md5``, of the text's UTF-8."""
    layout, measured = measure(docs, id_col, text_col, width, percent, block_bytes, bucket_bytes)
    firsts = measured.where("first")
    nodes = staged(firsts.groupBy("node").agg(F.max("n_shingles").alias("n")), "jaccard-nodes")
    # the shingles of a node, from one of the blocks that hold it
    holders = firsts.groupBy("node").agg(F.min(F.struct("doc_id", "text_md5")).alias("holder"))
    sets = firsts.join(holders.select(F.col("node").alias("h_node"), "holder"), (F.col("node") == F.col("h_node")) & F.struct("doc_id", "text_md5").eqNullSafe(F.col("holder"))).select("node", F.col("n_shingles").alias("n"), "shared", "posted")
    sets = staged(sets, "jaccard-sets")
    posted = sets.select("node", "n", "shared", F.posexplode("posted").alias("k", "s"))
    rest = F.octet_length("shared").cast("long") / 8 - F.col("k")  # shingles from this one on
    posted = posted.select("s", "node", "n", F.floor((rest * (100 + percent) - percent * F.col("n")) / percent).alias("reach"))
    widest = F.max(F.struct("reach", "node"))["node"].alias("low")
    ends = posted.groupBy("s").agg(widest, F.max("node").alias("high"), F.min("node").alias("least")).where("least <> high").withColumnRenamed("s", "e_s")
    posted = staged(posted.join(ends, F.col("s") == F.col("e_s")).select("s", "node", "n", "reach", "low", "high"), "jaccard-postings")
    groups = max(1, -(-int(sets.agg(F.coalesce(F.sum(F.octet_length("shared")), F.lit(0)).alias("b")).first()["b"]) // (4 << 20)))

    def cluster(postings: DataFrame) -> DataFrame:
        """Each node's best hub (low and high: two of the nodes of a posting), then the pieces of each hub's cluster."""
        offers = postings.select("node", F.explode(F.array("low", "high")).alias("hub")).where("node <> hub")
        best = offers.groupBy("node", "hub").count().groupBy("node").agg(F.max(F.struct("count", "hub"))["hub"].alias("hub"))
        members = best.withColumnRenamed("node", "m_node")
        counts = members.groupBy("hub").agg(F.count("*").alias("size")).withColumn("pieces", F.ceil(F.col("size") / piece))
        named = members.join(counts.withColumnRenamed("hub", "c_hub"), F.col("hub") == F.col("c_hub")).select("m_node", F.struct("hub", F.pmod(F.xxhash64("m_node"), F.col("pieces")).alias("piece")).alias("cluster"))
        hubs = counts.select(F.col("hub").alias("m_node"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece")).select("m_node", F.struct(F.col("m_node").alias("hub"), "piece").alias("cluster"))
        return sets.join(named.unionByName(hubs), F.col("node") == F.col("m_node")).select(F.concat(F.col("cluster.hub"), F.col("cluster.piece").cast("string").cast("binary")).alias("cluster"), "node", "n", "shared")

    comp = components(nodes, _linked(cluster(posted), percent, groups))

    def open_postings(comp: DataFrame) -> DataFrame:
        """Postings of more than one component, with the components."""
        own = posted.select("s", "node", "n", "reach").join(comp.select(F.col("node").alias("c_node"), "comp"), F.col("node") == F.col("c_node")).select("s", "node", "n", "reach", "comp")
        mixed = own.groupBy("s").agg(F.min("comp").alias("low_comp"), F.max("comp").alias("high_comp")).where("low_comp <> high_comp").withColumnRenamed("s", "e_s")
        return own.join(mixed, F.col("s") == F.col("e_s")).drop("e_s")

    def rejoin(comp: DataFrame, links: DataFrame) -> DataFrame:
        """Components of components."""
        a, b = comp.select(F.col("node").alias("na"), F.col("comp").alias("ca")), comp.select(F.col("node").alias("nb"), F.col("comp").alias("cb"))
        between = links.join(a, F.col("a") == F.col("na")).join(b, F.col("b") == F.col("nb")).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        upper = components(comp.select(F.col("comp").alias("node")).distinct(), between).select(F.col("node").alias("u"), F.col("comp").alias("to"))
        return staged(comp.join(upper, F.col("comp") == F.col("u")).select("node", F.col("to").alias("comp")), "jaccard-components")

    # hubs of the second round: a node of another component in the same posting
    still = open_postings(comp)
    hub = still.groupBy("s").agg(F.max_by("node", F.struct(F.col("comp") == F.col("low_comp"), F.col("reach"), F.col("node"))).alias("low"), F.max_by("node", F.struct(F.col("comp") == F.col("high_comp"), F.col("reach"), F.col("node"))).alias("high")).withColumnRenamed("s", "h_s")
    second = still.join(hub, F.col("s") == F.col("h_s")).select("node", "comp", "low_comp", "high_comp", "low", "high")
    second = second.select("node", F.when(F.col("comp") != F.col("low_comp"), F.col("low")).otherwise(F.col("high")).alias("low"), F.when(F.col("comp") != F.col("high_comp"), F.col("high")).otherwise(F.col("low")).alias("high"))
    comp = rejoin(comp, _linked(cluster(second), percent, groups))

    # the rest, pair by pair, inside the size bounds
    still = staged(open_postings(comp).select("s", "node", "n", "reach", "comp"), "jaccard-open")
    other = still.select(F.col("s").alias("s2"), F.col("node").alias("b"), F.col("n").alias("n2"), F.col("reach").alias("reach2"), F.col("comp").alias("comp2"))
    fitting = (F.col("s") == F.col("s2")) & (F.col("comp") < F.col("comp2")) & (F.col("n") <= F.col("reach2")) & (F.col("n2") <= F.col("reach"))
    pairs = staged(still.join(other, fitting).select(F.col("node").alias("a"), "b").distinct(), "jaccard-pairs")
    if not pairs.isEmpty():  # else the sets need not be dealt once more
        rest = pairs.select(F.concat("a", "b").alias("cluster"), F.explode(F.array("a", "b")).alias("p_node"))
        rest = sets.join(rest, F.col("node") == F.col("p_node")).select("cluster", "node", "n", "shared")
        comp = rejoin(comp, _linked(rest, percent, groups))

    member = measured.where("node IS NOT NULL").select("doc_id", "node").join(comp.withColumnRenamed("node", "c_node"), F.col("node") == F.col("c_node")).select("comp", "node", "doc_id")
    smallest = member.groupBy("comp").agg(F.min("doc_id").alias("least"))
    by_node = comp.join(smallest.withColumnRenamed("comp", "s_comp"), F.col("comp") == F.col("s_comp")).select(F.col("node").alias("r_node"), "least", F.col("comp").alias("class_key"))
    every = layout.expanded(measured.select("doc_id", "n_shingles", "node", "text_md5", "times"))
    return every.join(by_node, F.col("node") == F.col("r_node"), "left").select(
        "doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"), "class_key", "text_md5"
    )


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, one of each component: the smallest id, then the smallest text hash; rows without a shingle all stay.

    Only rows whose id may be among those that go or come twice are shuffled with their texts; the others stay where they are."""
    found = staged(jaccard_components(docs, id_col=id_col, text_col=text_col, **options).where("class_key IS NOT NULL").select("doc_id", "text_md5", "class_key"), "jaccard-classes")
    stays = found.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_md5")).alias("w")).select(F.col("class_key").alias("w_key"), F.col("w.doc_id").alias("w_id"), F.col("w.text_md5").alias("w_md5"))
    goes = found.join(stays, F.col("class_key") == F.col("w_key")).where(~(F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("text_md5") == F.col("w_md5")))).select(F.col("doc_id").alias("g_id"), F.col("text_md5").alias("g_md5")).distinct()
    twice = found.groupBy(F.col("doc_id").alias("g_id"), F.col("text_md5").alias("g_md5")).count().where("count > 1").drop("count")
    goes, twice = staged(goes, "jaccard-goes"), staged(twice, "jaccard-repeats")
    stay, rest = parted(docs, goes.select("g_id").unionByName(twice.select("g_id")), id_col)
    return stay.unionByName(_once(without(rest, goes, id_col, text_col), twice, id_col, text_col))


def parted(docs: DataFrame, ids: DataFrame, id_col: str, bits: int = 24) -> tuple[DataFrame, DataFrame]:
    """The rows whose id is surely not among ``ids`` (g_id), and the rest, which holds all that are.

    A bitmap of the ids' hashes is broadcast, ``2**bits`` bits at most; more ids only make the rest larger."""
    def at(c):
        return F.pmod(F.xxhash64(c), F.lit(2**bits))

    words = ids.select(at(F.col("g_id")).alias("at")).groupBy(F.shiftright("at", 6).alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(64)).cast("int"))).alias("_mask"))
    words = F.broadcast(staged(words, "jaccard-bitmap"))
    own = at(col(docs, id_col).cast("long"))
    marked = docs.join(words, F.shiftright(own, 6) == words["_word"], "left")
    hit = F.coalesce(F.getbit(words["_mask"], F.pmod(own, F.lit(64)).cast("int")), F.lit(0)) == 1
    return tuple(marked.where(w).select(*[col(docs, c) for c in docs.columns]) for w in (~hit, hit))


def without(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str, how: str = "left_anti") -> DataFrame:
    """The rows whose (id, md5 of the text) is not among ``keys`` (g_id, g_md5)."""
    key = col(docs, id_col).cast("long").eqNullSafe(keys["g_id"]) & (F.md5(F.coalesce(col(docs, text_col), F.lit("")).cast("binary")) == keys["g_md5"])
    return docs.join(keys, key, how)


def _once(docs: DataFrame, twice: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with the same id and text, where there are any, once."""
    if twice.isEmpty():
        return docs
    return without(docs, twice, id_col, text_col).unionByName(without(docs, twice, id_col, text_col, "left_semi").dropDuplicates([id_col, text_col]))
