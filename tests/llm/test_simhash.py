"""SimHash components against comparing all pairs of fingerprints."""

import random
from collections import Counter

import brute
import numpy as np
import xxhash
from test_operators import same, tuples

from sluice.llm import simhash


def simhash_of(text, width=4):
    w = brute.words((text or "").translate(brute.LOWER))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + width]).encode(), 42) for i in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_rows(rows, bits=4, with_root=False):
    """(id, fingerprint, component) of each row; or the component's least id by its root."""
    prints = [simhash_of(t) for _, t in rows]
    every = sorted(set(prints))
    parent = {f: f for f in every}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(every):
        for b in every[:i]:
            if (a ^ b).bit_count() <= bits:
                parent[root(a)] = root(b)
    least = {}
    for (d, _), f in zip(rows, prints, strict=True):
        least[root(f)] = min(least.get(root(f), brute.LAST), brute.key(d))
    if with_root:
        return least
    ids = [least[root(f)] for f in prints]
    return [(d, f"{f:016x}", None if c == brute.LAST else c) for (d, _), f, c in zip(rows, prints, ids, strict=True)]


def test_simhash_components(docs, rows, nothing):
    for options in ({}, {"piece": 2, "rows_per_task": 5}):
        out = simhash.simhash_components(docs, **options)
        same(tuples(out, "doc_id", "fingerprint", "component_id"), simhash_rows(rows))
    assert simhash.simhash_components(nothing).count() == 0


def test_fingerprints_do_not_depend_on_the_chunks(rows):
    for _, t in rows:
        for chunk in (1, 7, 40, 1 << 20):
            assert simhash.fingerprint((t or "").encode(), chunk=chunk) == simhash_of(t)


def test_one_row_of_each_component_stays(docs, rows):
    kept = simhash.drop_simhash_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [brute.key(r["doc_id"]) for r in kept.collect()]
    assert sorted(ids) == sorted(simhash_rows(rows, with_root=True).values())  # two components may have one least id


def test_a_cut_bucket_loses_no_link(spark):
    """Fingerprints close to one another in groups and chains, in buckets of many pieces."""
    rng = random.Random(2)
    center, prints = rng.getrandbits(64), set()
    for far in (0, 9, 20):  # three dense groups in common buckets, and chains between
        own = center
        for b in rng.sample(range(40), far):
            own ^= 1 << b
        for _ in range(70):
            x = own
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(40)
            prints.add(x)
    prints |= {rng.getrandbits(64) for _ in range(30)}
    fps = np.array(sorted(prints), np.uint64)
    nodes = spark.createDataFrame([(int(f), 1) for f in fps.view(np.int64)], "fp long, docs long").repartition(4)
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= 4):
            parent[root(i)] = root(int(j))
    expected = Counter(Counter(root(i) for i in range(len(fps))).values())
    assert len(expected) > 2
    for piece in (3, 16, 1000):
        found, cut = simhash.simhash_links(nodes, len(fps), 4, 8, piece, 64)
        comp = simhash.components(nodes.selectExpr("fp AS node"), found)
        rest = simhash._rest_links(cut, comp, 4, 8, piece, 64)
        comp = comp.collect()
        at, to = {r["node"]: r["comp"] for r in comp}, {r["comp"]: r["comp"] for r in comp}
        for a, b in [] if rest is None else [(r["a"], r["b"]) for r in rest.collect()]:
            x, y = at[a], at[b]
            while to[x] != x:
                x = to[x]
            while to[y] != y:
                y = to[y]
            to[x] = y

        def end(x):
            while to[x] != x:
                x = to[x]
            return x

        assert Counter(Counter(end(c) for c in at.values()).values()) == expected
        assert (rest is None) == (piece == 1000)


def test_tables_discard_only_pairs_that_are_far():
    rng = np.random.default_rng(4)
    fp = rng.integers(0, 2**63, 300).astype(np.uint64)
    fp[150:] = fp[:150] ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64))
    i, j = np.triu_indices(300, 1)
    a, b = simhash.survivors(i, j, fp, simhash.distance_table(fp, 24), 4)
    near = np.bitwise_count(fp[i] ^ fp[j]) <= 4
    assert sorted(zip(a.tolist(), b.tolist())) == sorted(zip(i[near].tolist(), j[near].tolist()))


def test_parts_grow_with_the_nodes():
    assert simhash.part_count(1000, 4) == 5 and simhash.part_count(10**7, 4) == 6 and simhash.part_count(10**10, 4) >= 7
    for parts in (5, 6, 7, 9):
        masks = simhash.bucket_masks(parts, 4)
        assert all(m.bit_count() >= 64 * (parts - 4) // parts - parts for m in masks)
        rng = random.Random(parts)
        for _ in range(200):  # any four bits leave some choice untouched
            flips = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not m & flips for m in masks)
