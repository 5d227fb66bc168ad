"""Importance resampling against a plain version; selection against a sort."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from test_operators import same, tuples

from sluice.llm import resampling
from sluice.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SF = "/root/testdata/sf0.001"


def words(text):
    return WORD.findall((text or "").translate(brute.LOWER))


def features(text):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def resampled(rows, target, percent=5):
    """(id, features, weight, score, rank) of each row."""
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(features(text))
    for text in target:
        t.update(features(text))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    out, able = [], []
    for d, text in rows:
        own = features(text)
        weight = sum(map(gain, own))
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if len(words(text)) >= 20:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], brute.key(r[0])))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return [tuple(r) for r in out]


def test_features_of_odd_texts():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcXYZ09 .-é語\n\x7f@[`{") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    texts += ["a" * 64 + " b " + "c" * 65 + " d " + "é" * 300 + " x y", "", "a", "A B"]
    got = [[] for _ in texts]
    for doc, bucket in resampling.feature_buckets([t.encode() for t in texts], 3, 10000):
        for d, b in zip(doc.tolist(), bucket.tolist(), strict=True):
            got[d].append(b)
    assert [sorted(g) for g in got] == [sorted(features(t)) for t in texts]


def test_resample(spark, docs, rows, nothing):
    target = [rows[3][1], "a b c", None, ""]
    frame = spark.createDataFrame([(t, 7) for t in target], "text string, n long")
    for percent in (5, 40, 100, 0):
        out = resampling.resample(docs, frame, percent=percent, chunk_rows=7, base=3, slot_rows=4)
        same(tuples(out, "doc_id", "n_features", "weight", "score", "rank"), resampled(rows, target, percent))
    none = frame.where("false")
    same(tuples(resampling.resample(docs, none), "doc_id", "n_features", "weight", "score", "rank"), resampled(rows, []))
    assert resampling.resample(nothing, frame).count() == 0 and resampling.draw_documents(nothing, frame).count() == 0


def test_drawn_documents_are_rows(spark, docs, rows):
    frame = spark.createDataFrame([("a b c",)], "text string")
    drawn = resampling.draw_documents(docs, frame, percent=60)
    expected = Counter(d for d, *_, rank in resampled(rows, ["a b c"], 60) if rank)
    assert drawn.columns == docs.columns and Counter(r["doc_id"] for r in drawn.collect()) == expected


@pytest.mark.parametrize("seed", range(4))
def test_selection_finds_every_rank_and_discards_a_quarter(spark, seed):
    rng = random.Random(seed)
    spread = (1, 5, 1000, 10**9)[seed]
    keys = [(rng.randint(-spread, spread), rng.choice([1, 2, 2**63 - 1]), i) for i in range(400)]
    frame = spark.createDataFrame(keys, "a long, b long, c long").repartition(3 + seed)
    for rank in (1, 37, 399, 400):
        assert resampling.cutoff_key(frame, rank, chunk_rows=40, base=8) == sorted(keys)[rank - 1]
    assert resampling.cutoff_key(frame, 0) is None and resampling.cutoff_key(frame, 401) is None
    chunks = np.array_split(np.array(sorted(keys, key=lambda k: rng.random())), 1 + 5 * seed)
    pivot = resampling.weighted_median([(len(c), resampling._median(*c.T)) for c in chunks])
    assert len(keys) / 4 - len(chunks) <= sorted(keys).index(pivot) <= 3 * len(keys) / 4 + len(chunks)


def test_query_matches_the_plain_version(spark):
    table = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    out = QUERIES["op11_resampling"](spark, SF)
    assert [t for _, t in out.dtypes] == ["bigint"] * 5
    same(tuples(out, "doc_id", "n_features", "weight", "score", "rank"), resampled(table, target))
