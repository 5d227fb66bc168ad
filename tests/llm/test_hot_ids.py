"""Blocks: one id, or a null id, in a third of the rows; runs of very long documents."""

import random

import brute
import numpy as np
import pytest
from test_operators import same, tuples

from sluice.llm import suffixes
from sluice.llm.blocks import NO_ID, Layout
from sluice.llm.jaccard import drop_near_duplicates, jaccard_components
from sluice.llm.substrings import remove_repeated_windows

SMALL = {"block_bytes": 700, "bucket_bytes": 2000}


@pytest.fixture(scope="module")
def hot_rows():
    rng = random.Random(11)
    prose = lambda n: " ".join("".join(rng.choice(["ta", "re", "mi", "Lé"]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    passage, copy = prose(28), prose(40)
    rows = [(d, f"{prose(rng.randint(0, 12))} {passage if rng.random() < 0.5 else prose(20)} {prose(rng.randint(0, 9))}") for d in [None] * 14 + [5] * 9 + list(range(-4, 16))]
    rows += [(None, copy)] * 8 + [(5, copy)] * 5 + [(15, copy), (16, copy), (None, None), (None, ""), (5, "")]
    rows += [(20 + i, prose(400)) for i in range(3)] + [(30, f"{copy} {prose(3)}"), (None, f"{copy} {prose(2)}")]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def hot(spark, hot_rows, schema):
    out = [(t, "en", "a", d, len(t) if t else None, 1, "s", "n", "h", 2, 0.5, "x", 3, "b") for d, t in hot_rows]
    return spark.createDataFrame(out, schema).repartition(4)


def test_layout_bounds_the_bytes_of_a_block(hot, hot_rows):
    layout = Layout(hot, "doc_id", "text", 700, 2000)
    assert set(layout.hot) == {5, NO_ID} and layout.rank.tolist() == sorted(layout.rank.tolist()) and max(layout.parts) > 2
    rows = layout.pack().collect()
    got = []
    for r in rows:
        ids, times = np.frombuffer(r["ids"], np.int64).reshape(2, -1)
        lens = np.frombuffer(r["lens"], np.int64)
        got += [(r["block"], i, n, t) for i, n, t in zip(ids.tolist(), lens.tolist(), times.tolist(), strict=True)]
    assert sum(t for *_, t in got) == len(hot_rows)
    for block in {b for b, *_ in got}:
        own = [n for b, _, n, _ in got if b == block]
        assert sum(own) <= 3 * 700 or len(own) == 1  # a hash deals the texts of a hot id: about block_bytes each
    by_rank = {}
    for b, i, *_ in got:
        by_rank.setdefault(int(layout.rank[b]), set()).add(i)
    edges = [(min(x), max(x)) for _, x in sorted(by_rank.items())]
    assert all(a[1] < b[0] for a, b in zip(edges, edges[1:]))


def test_operators_on_hot_ids(hot, hot_rows):
    out = suffixes.remove_repeated_strings(hot, **SMALL)
    same(tuples(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), brute.repeated_strings(hot_rows))
    out = remove_repeated_windows(hot, **SMALL)
    same(tuples(out, "doc_id", "n_words", "n_removed", "kept_sha256"), brute.repeated_windows(hot_rows))
    out = jaccard_components(hot, piece=3, **SMALL)
    same(tuples(out, "doc_id", "n_shingles", "component_id"), brute.components(hot_rows))
    groups = len({c for c in _classes(hot_rows)})
    kept = [r["text"] for r in drop_near_duplicates(hot, **SMALL).collect()]
    assert len([t for t in kept if brute.shingles(t)]) == groups


def _classes(rows):
    """One label for each group of linked rows with shingles."""
    sets = [brute.shingles(t) for _, t in rows if brute.shingles(t)]
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = label[i], label[j]
                label = [y if v == x else v for v in label]
    return label
