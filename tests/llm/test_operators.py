"""Each operator against its plain version on a small table of hard cases, and on an empty one."""

import math
import re
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from sluice.llm import packing, quality_gbt, suffixes
from sluice.llm.blocks import bucket_slices
from sluice.llm.blocks import joined as joined_bytes
from sluice.llm.fingerprints import EMPTY, compare_fingerprints, lexicon_table
from sluice.llm.jaccard import cluster_links, drop_near_duplicates, jaccard_components, parted
from sluice.llm.langid import Classifier, identify_languages, train_dictionaries
from sluice.llm.mixing import apply_mix, mix_sources
from sluice.llm.quality_rules import apply_quality_rules, base_counts, slot_bits_for
from sluice.llm.secrets import Scanner, entropy_spans, joined, redact_secrets, scan_secrets
from sluice.llm.substrings import remove_repeated_windows

SMALL = {"block_bytes": 1500, "bucket_bytes": 3000}


def tuples(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def same(got, expected):
    assert got == sorted(expected, key=repr)


def test_repeated_strings(docs, rows, nothing):
    out = suffixes.remove_repeated_strings(docs, with_kept=True, **SMALL)
    same(tuples(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), brute.repeated_strings(rows))
    assert suffixes.remove_repeated_strings(nothing).count() == 0


def test_open_strings_are_kept_for_the_last_pass_and_sorted_once(docs, monkeypatch):
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 900):
        flags, place, cls = rng.random(5 * n + 1) < 0.3, rng.permutation(5 * n + 1)[:n], rng.integers(0, 70_000, n)
        a, b, c = suffixes.state_of(zstandard.ZstdDecompressor().decompress(suffixes.kept_state(flags, place, cls)))
        by = np.argsort(place)
        assert a.tolist() == flags.tolist() and b.tolist() == place[by].tolist() and c.tolist() == cls[by].tolist()
    passes = []
    real = suffixes.per_block
    monkeypatch.setattr(suffixes, "per_block", lambda rows, work, *more, **named: passes.append(work) or real(rows, work, *more, **named))
    suffixes.remove_repeated_strings(docs, **SMALL)
    sorting = [w.__name__ for w in passes if "opened" in w.__code__.co_freevars]
    assert len(passes) == 3 and sorting == ["send_open"]


def test_anchors_are_dealt_evenly_to_the_buckets():
    text = np.random.default_rng(5).integers(97, 123, 200_000).astype(np.uint8).tobytes()
    key, _, _ = suffixes.Anchors(*joined_bytes([text]), 50, 20).entries(64 - 42)
    sizes = [e - s for _, s, e in bucket_slices(key, 64, 42)]
    assert sum(sizes) == len(key) > 64 * 100 and max(sizes) < 2 * len(key) / 64


def test_suffix_sort_is_a_sort_and_survives_hash_collisions(monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, (400, 12)).astype(np.uint8)
    data[200:] = data[:200]
    group = rng.integers(0, 7, 400)
    group[200:] = group[:200]
    expected = sorted((int(g), d.tobytes()) for g, d in zip(group, data))
    for collide in (False, True):
        if collide:  # all bytes hash alike: every pair of suffixes seems equal
            monkeypatch.setattr(suffixes, "BYTES", np.ones(256, np.uint64))
        order, equal = suffixes.sort_suffixes(data, group)
        assert [(int(group[i]), data[i].tobytes()) for i in order] == expected
        assert equal.tolist() == [False] + [a == b for a, b in zip(expected, expected[1:])]


def test_repeated_windows(docs, rows, nothing):
    out = remove_repeated_windows(docs, with_text=True, **SMALL)
    same(tuples(out, "doc_id", "n_words", "n_removed", "kept_sha256"), brute.repeated_windows(rows))
    for r in out.collect():
        assert sum(s["end"] - s["start"] for s in r["intervals"]) == r["n_removed"] and len(r["kept_text"].split()) == r["n_words"] - r["n_removed"]
    assert remove_repeated_windows(nothing).count() == 0


def test_base_counts_and_rules(spark, docs, rows, nothing):
    out = base_counts(docs)
    same(tuples(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), [(d, *brute.base_counts(t)[:5]) for d, t in rows])
    labels = spark.createDataFrame([(1, 1), (2, 1), (2, 0), (None, 1), (777, 1), (5, None)], "doc_id bigint, quality int")
    ruled = apply_quality_rules(docs, labels, slot_bytes=64)
    same(tuples(ruled, "doc_id", "base_failed"), [(d, brute.base_counts(t)[5]) for d, t in rows])
    assert all(not r["kept"] for r in ruled.where("base_failed").collect())
    none = apply_quality_rules(docs, labels.where("false"), slot_bytes=64)
    assert none.where("score <> 0").count() == 0 and none.where("kept = base_failed").count() == 0
    assert apply_quality_rules(nothing, labels, slot_bytes=64).count() == 0


def test_ratio_scores(spark, docs):
    """Every score from the counts of the other occurrences, by hand; ids 1 and 12 are trusted, 2 is not (two labels)."""
    labels = spark.createDataFrame([(1, 1), (12, 1), (2, 1), (2, 0), (None, 1), (777, 1), (5, None)], "doc_id bigint, quality int")
    bits = slot_bits_for(docs, "text", 64, 19)
    grams = [(r["doc_id"], [h % 2**bits for h in r["h1"] + r["h2"]]) for r in base_counts(docs).collect()]
    raw, trusted = Counter(h for _, own in grams for h in own), Counter(h for d, own in grams if d in (1, 12) for h in own)
    R, T = sum(raw.values()), sum(trusted.values())

    def score(d, own):
        total = 0
        for h in own:
            near = max(0, trusted[h] - (d in (1, 12))) + 0.5 * T / 2**bits
            total += max(-127, min(127, round(16 * (math.log(near) - math.log(raw[h] - 1 + 0.5 * R / 2**bits) + math.log(R / T)))))
        return total / (16 * max(1, len(own)))

    got = tuples(apply_quality_rules(docs, labels, slot_bytes=64).selectExpr("doc_id", "round(score, 6) AS score"), "doc_id", "score")
    same(got, [(d, round(score(d, own), 6)) for d, own in grams])


def test_slots_follow_the_corpus_up_to_a_bound(spark):
    sizes = [slot_bits_for(spark.createDataFrame([("x" * 1000,)] * n, "text string"), "text", 16, 13) for n in (0, 1, 16, 64, 200)]
    assert sizes == [8, 8, 10, 12, 13]


def test_jaccard_components(docs, rows, nothing):
    out = jaccard_components(docs, piece=3, **SMALL)
    same(tuples(out, "doc_id", "n_shingles", "component_id"), brute.components(rows))
    assert jaccard_components(nothing).count() == 0
    kept = drop_near_duplicates(docs, **SMALL)
    assert kept.columns == docs.columns
    blank = sum(1 for _, t in rows if not brute.shingles(t))
    # one row for each group of linked rows
    left = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len([1 for _, t in left if not brute.shingles(t)]) == blank
    full = [r for r in left if brute.shingles(r[1])]
    assert Counter(c for _, _, c in brute.components(full)) == Counter(c for _, _, c in brute.components(full))
    sets = [brute.shingles(t) for _, t in full]
    assert not any(100 * len(a & b) >= 75 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    linked = {brute.shingles(t) for _, t in rows if brute.shingles(t)}
    assert all(any(s == a or _reach(s, a, linked) for a in sets) for s in linked)


def test_only_rows_that_may_go_are_shuffled_with_their_texts(spark, docs):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = drop_near_duplicates(docs, **SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "Union" in plan and "Exchange hashpartitioning" not in plan.split("Union")[1].split("Filter")[0]
        ids = spark.createDataFrame([(24,), (25,), (None,)], "g_id long")
        every = sorted(docs.select("doc_id", "text").collect(), key=repr)
        for bits in (24, 6, 2):  # few bits: more rows in the rest, none lost
            stay, rest = parted(docs, ids, "doc_id", bits)
            assert "Exchange hashpartitioning" not in stay._jdf.queryExecution().executedPlan().toString()
            held = [rest.select("doc_id", "text").collect(), stay.select("doc_id", "text").collect()]
            assert sorted(held[0] + held[1], key=repr) == every
            assert {24, 25, None} <= {r["doc_id"] for r in held[0]} and not {24, 25, None} & {r["doc_id"] for r in held[1]}
        assert parted(docs, ids.where("false"), "doc_id")[1].isEmpty()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _reach(a, b, every):
    seen, front = {a}, [a]
    while front:
        x = front.pop()
        for y in every - seen:
            if 100 * len(x & y) >= 75 * len(x | y):
                seen.add(y)
                front.append(y)
    return b in seen


def test_cluster_product_counts_in_blocks():
    sets = [np.arange(s, s + 40, dtype=np.uint64) for s in (0, 3, 6, 100, 103)]
    links = list(cluster_links([bytes([i]) for i in range(5)], np.full(5, 40), sets, 75, columns=7))
    assert sorted(tuple(sorted((a[0], b[0]))) for a, b in links) == [(0, 1), (1, 2), (3, 4)]


def test_mix(docs, rows, nothing):
    out = mix_sources(docs, slot_rows=7)
    got = out.collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
    want = brute.targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] == r["copies"] * r["size"] and r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert sorted(r["size"] for r in got) == sorted(len(brute.words(t)) for _, t in rows)
    assert all(abs(taken[s] - want[s]) <= 120 for s in want) and sum(taken.values()) <= sum(sizes.values())
    again = mix_sources(docs.repartition(2), slot_rows=1000)
    assert tuples(again, "doc_id", "source", "size", "taken") == tuples(out, "doc_id", "source", "size", "taken")
    assert mix_sources(nothing).count() == 0
    mixed = apply_mix(docs)
    assert mixed.columns == docs.columns and sum(len(brute.words(r["text"])) for r in mixed.select("text").collect()) <= sum(sizes.values())


def test_mix_repeats_small_sources(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "big" if i < 90 else "a") for i in range(100)], "doc_id bigint, text string, source string")
    out = mix_sources(docs)
    taken = {r["source"]: (r["taken"], r["target"]) for r in out.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()}
    assert taken["a"] == (300, 300.0) and taken["big"] == (700, 700.0)


def test_secrets(docs, rows, nothing):
    out = scan_secrets(docs)
    expected = [(d, *(sum(1 for x in brute.secrets(t) if x[1] == k) for k in range(3))) for d, t in rows]
    same(tuples(out, "doc_id", "n_assign", "n_access", "n_hex"), expected)
    base = lambda s: ",".join(x for x in s.split(",") if x and not x.startswith("entropy"))
    assert sorted(base(r["spans"]) for r in out.collect()) == sorted(joined(brute.secrets(t)) for _, t in rows)
    by_id = {r["doc_id"]: r["spans"] for r in out.where("doc_id IN (55, 56, 57, 59)").collect()}
    assert by_id[57].startswith("entropy:5:") and by_id[59] == "" and "assign" in by_id[55] and "access" in by_id[56]
    assert scan_secrets(nothing).count() == 0
    clean = redact_secrets(docs)
    assert clean.schema == docs.schema
    scanner = Scanner()
    assert not any(scanner.base(r["text"] or "") for r in clean.select("text").collect())
    assert sorted(map(repr, (t for _, t in rows if not scanner.spans(t or "")[1]))) == sorted(repr(r["text"]) for r in clean.select("text").collect() if "[REDACTED]" not in (r["text"] or ""))


def test_secrets_short_padded_and_beside_example_words():
    found = lambda text: [text[s:e] for s, k, e in Scanner().spans(text)[1] if k == 3]
    key = "9fK3bQz7LmXw2PsVt8RnYc"
    assert found(f"use {key}== here") == [f"{key}=="] and found(f"use {key[:20]} here") == [key[:20]]
    assert found("id 3f9a1c7e5b2d8064af13 end") == ["3f9a1c7e5b2d8064af13"]
    for before in ("example_app/", "your_", "some/placeholder/", "myExampleApp-", "abcdefghijklmnopqrstuvwxyz/"):
        got = found(f"{before}{key}{key[::-1]} and")
        assert len(got) == 1 and key in got[0], before
    assert found(f"{key}{key[::-1]}/example_app")[0].startswith(key + key[::-1])
    assert found("report_2024-Q3_final getUserNameFromTable2 wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY") == []
    assert found("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/ 123e4567-e89b-12d3-a456-426614174000") == []


def test_entropy_windows_match_direct_sums():
    rng = np.random.default_rng(1)
    for n, least in ((60, 3.0), (100, 2.5), (30, 3.4), (5, 1.0)):
        text = "".join(rng.choice(list("abcdefgh"), n))
        flags = [False] * n
        for i in range(n - 16 + 1):
            c = np.array(list(Counter(text[i : i + 16]).values())) / 16
            if -(c * np.log2(c)).sum() >= least - 1e-9:
                flags[i : i + 16] = [True] * 16
        merged = [(s, next((j for j in range(s, n) if not flags[j]), n)) for s in brute.runs(flags)]
        assert _merge(entropy_spans(text, 16, least)) == merged


def _merge(spans):
    out = []
    for s, e in spans:  # touching spans of the scan count as one here
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def test_fingerprints(docs, rows, nothing):
    out = compare_fingerprints(docs, low=0.02, high=0.6, slot_bits=10).collect()
    same(sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in out), key=repr), brute.edited(rows))
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)
    text = {d: t for d, t in rows if d not in (12, 13, None)}
    by_text = defaultdict(set)
    for r in out:
        if r["doc_id"] in text:
            by_text[text[r["doc_id"]] or ""].add(r["fingerprint"])
    assert all(len(f) == 1 for f in by_text.values())
    assert next(r for r in out if r["doc_id"] == 44)["near_next"] == 1.0  # 45 has the same text
    assert compare_fingerprints(nothing, slot_bits=10).count() == 0


def test_fingerprints_of_a_large_group_of_near_copies_and_of_copies(spark):
    base = [f"hot{i}" for i in range(150)]
    near = [(i, " ".join([*base[:i], f"edit{i}", *base[i + 1 :]])) for i in range(40)]
    rest = [(100 + i, " ".join(f"w{(i * 7 + j) % 400}" for j in range(120))) for i in range(40)]
    got = {r["doc_id"]: r for r in compare_fingerprints(spark.createDataFrame(near + rest, "doc_id bigint, text string"), slot_bits=12).collect()}
    assert all(got[i]["near_next"] >= 0.5 for i in range(39)) and got[39]["near_next"] < 0.2
    # copies count once in the document frequencies
    once = [(i, " ".join(f"t{(i + j) % 60}" for j in range(12))) for i in range(60)]
    tables = [lexicon_table(spark.createDataFrame(some, "doc_id bigint, text string"), low=0.1, high=0.3, slot_bits=10).first()["tags"] for some in (once, once + [(100 + k, once[0][1]) for k in range(50)])]
    assert tables[0] == tables[1] and any(t != EMPTY for t in tables[0])


def test_the_lexicon_is_no_literal_of_the_plan(spark):
    some = spark.createDataFrame([(i, " ".join(f"t{(i + j) % 60}" for j in range(12))) for i in range(60)], "doc_id bigint, text string")
    plans = [compare_fingerprints(some, low=0.1, high=0.3, slot_bits=bits)._jdf.queryExecution() for bits in (8, 14)]
    sizes = [len(re.sub(r"\d+", "", p.toString())) for p in plans]  # without numbers: columns and lambda variables are counted on
    assert abs(sizes[1] - sizes[0]) < 2000
    assert "_tables" not in plans[0].executedPlan().toString()  # nor a column of the rows


def test_one_document_follows_itself(spark):
    one = spark.createDataFrame([(3, "abcdefgh")], "doc_id bigint, text string")
    r = compare_fingerprints(one).first()
    assert r["near_next"] == 1.0 and r["n_chars"] == 8 and r["edited_sha256"] == brute.edited([(3, "abcdefgh")])[0][2]


def test_packing_round_trip(docs, rows, nothing):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    plain.encode_special_tokens = True
    out = packing.pack_documents(docs, capacity=64, shard_pieces=30, with_ids=True).collect()
    want = Counter()
    for d, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        first, at = len(ids) % 64 or 64, 0
        for k, end in enumerate(range(first, len(ids) + 1, 64)):
            want[(d, k, at, tuple(ids[at:end]))] += 1
            at = end
    assert Counter((r["doc_id"], r["piece"], r["start"], tuple(r["ids"])) for r in out) == want
    bins = defaultdict(list)
    for r in out:
        assert r["length"] == len(r["ids"])
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r["length"] for r in out)
    assert len(bins) <= -(-total // 64) + 3
    assert packing.pack_documents(nothing).count() == 0


def test_packing_encodes_a_literal_special_token_as_text():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import pyarrow as pa
    from tokenizers import Tokenizer

    texts = ["one <|endoftext|> two", "<|endoftext|>", "a<|endoftext|><|endoftext|>\n b"]
    plain = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    plain.encode_special_tokens = True
    ids, at = packing.Tokenizer(str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN).batch(pa.array(texts), 2)
    got = [ids[s:e].tolist() for s, e in zip(at, at[1:])]
    assert got == [plain.encode(t, add_special_tokens=False).ids + [2] for t in texts] and all(50256 not in g for g in got)


def test_genetic_packing_improves_and_stays_valid():
    import random

    rng = random.Random(2)
    size = [rng.choice([6, 7, 9, 11, 13, 17, 23, 31]) for _ in range(300)]
    island = packing.Island(size, 40, 1, 4)
    island.start()
    before = min(len(bins) for bins, _ in island.members)
    island.evolve(8)
    best = island.elite()
    assert sorted(i for b in best for i in b) == list(range(300)) and all(sum(size[i] for i in b) <= 40 for b in best)
    assert len(best) <= before
    assert [sorted(b) for b in packing.open_bins(packing.pack_bins(best, 300))] == [sorted(b) for b in best]


def test_language_and_quality_on_odd_rows(spark, docs, rows, nothing):
    got = identify_languages(docs, F.col("doc_id") > 3)
    assert got.count() == len(rows)
    for r in got.collect():
        t = next((x for d, x in rows if d == r["doc_id"] and d not in (12, 13, None)), "?")
        if t != "?":
            assert (r["lang_pred"] == "und") == (not t or not re.search(r"[^\W\d_]", t)) and 0 <= r["score"] <= 1
    assert {r[0] for r in identify_languages(docs, F.lit(False)).select("lang_pred").collect()} == {"und"}
    assert identify_languages(nothing, F.lit(True)).count() == 0
    labels = spark.createDataFrame([(d, d % 2) for d in range(40)] + [(3, 0), (None, 1), (7, None)], "doc_id bigint, quality int")
    for marks in (labels, labels.where("false"), labels.where("quality = 1")):
        scored = quality_gbt.classify_quality(docs, marks)
        assert scored.count() == len(rows) and scored.where("score < 0 OR score > 1 OR isnan(score) OR (score >= 0.3) <> (predicted = 1)").count() == 0
    assert quality_gbt.classify_quality(nothing, labels).count() == 0
    assert quality_gbt.keep_quality(docs, labels).columns == docs.columns


def test_language_sample_has_no_copies_and_no_shared_opening(spark):
    opening = "licence " * 80
    rows = [("en", "same words again " * 40)] * 300 + [("en", opening + " ".join(f"en{chr(97 + i % 26)}{chr(97 + j % 26)}" for j in range(300))) for i in range(60)]
    (name, content), = train_dictionaries(spark.createDataFrame(rows, "lang string, text string"))
    assert name == "en" and content.count(b"same words again") <= 512 // 17 + 1
    assert content.count(b"licence") * 8 < len(content) / 2 and content.count(b"en") > 1000


def test_every_language_has_a_dictionary(spark):
    word = lambda i, j: f"{chr(97 + i // 26)}{chr(97 + i % 26)}{chr(97 + j)}{chr(97 + (i * j) % 26)}q"
    texts = [(i, f"l{i:03}", " ".join(word(i, j) for j in range(26))) for i in range(230)]
    got = identify_languages(spark.createDataFrame(texts, "doc_id bigint, lang string, text string").repartition(1), F.lit(True)).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} == {i: lang for i, lang, _ in texts}
    some = [(lang, text.encode()) for _, lang, text in texts[:7]]
    several, one = Classifier(some, group=3), Classifier(some)
    assert several.classify_all([t for _, _, t in texts[:9]] + [None, "1 2"]) == [one.classify(t) for t in [t for _, _, t in texts[:9]] + [None, "1 2"]]


def test_flat_trees_match_a_walk_by_hand():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 4))
    y = ((x[:, 0] > 0.2) ^ (x[:, 2] < -0.5)).astype(float)
    model = quality_gbt.BoostedTrees(rounds=30).fit(x, y)
    p = model.predict(x)
    assert ((p > 0.5) == (y > 0.5)).mean() > 0.97
    for row in range(0, 500, 97):
        m = model.base
        for feature, cut, leaf in zip(model.feature, model.cut, model.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if x[row, feature[node]] > cut[node] else 1)
            m += leaf[node - len(feature)]
        assert abs(p[row] - 1 / (1 + np.exp(-m))) < 1e-12
