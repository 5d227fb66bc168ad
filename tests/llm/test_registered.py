"""The registered queries over whole given tables against the plain versions; held-out accuracy; the pipeline's stages."""

import sys
from pathlib import Path

import brute
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from sluice.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def table(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def got(spark, name, *columns):
    return sorted((tuple(r[c] for c in columns) for r in QUERIES[name](spark, SF).collect()), key=repr)


def test_queries_match_the_plain_versions(spark, table):
    assert got(spark, "op1_suffixes", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.repeated_strings(table), key=repr)
    rules = got(spark, "op2_quality_rules", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert rules == sorted(((d, *brute.base_counts(t)) for d, t in table), key=repr)
    assert got(spark, "op4_jaccard", "doc_id", "n_shingles", "component_id") == sorted(brute.components(table), key=repr)
    assert got(spark, "op6_substrings", "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.repeated_windows(table), key=repr)
    assert got(spark, "op9_secrets", "doc_id", "n_assign", "n_access", "n_hex") == sorted(((d, *(sum(x[1] == k for x in brute.secrets(t)) for k in range(3))) for d, t in table), key=repr)
    assert got(spark, "op10_fingerprints", "doc_id", "n_chars", "edited_sha256") == sorted(brute.edited(table), key=repr)


def test_held_out_language_and_quality(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op3_language"](spark, SF01).where("held_out").collect()
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in rows) >= 0.95 * len(rows)
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op7_quality"](spark, SF01).where("held_out").collect() if r["doc_id"] in marks]
    assert sum(r["predicted"] == marks[r["doc_id"]] for r in rows) >= 0.95 * len(rows)
    kept = {r["doc_id"]: r["kept"] for r in QUERIES["op2_quality_rules"](spark, SF01).collect()}
    good = [kept[d] for d, q in marks.items() if q == 1 and len(brute.words(_text(spark, d))) >= 20]
    assert sum(good) >= 0.97 * len(good)


_texts = {}


def _text(spark, doc_id):
    if not _texts:
        _texts.update({r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()})
    return _texts[doc_id]


def test_pipeline_stages_one_by_one(spark):
    import corpus_pipeline
    from sluice.llm.common import staged
    from sluice.llm.secrets import Scanner

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "secrets", "mixing", "packing"]

    good = staged(stages["quality"](spark, docs, SF), "t")
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = {r["doc_id"] for r in good.collect()}
    assert good.columns == columns and sum((d in ids) == (q == 1) for d, q in marks.items()) >= 0.95 * len(marks)

    single = staged(stages["near_duplicates"](spark, good, SF), "t")
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    assert single.columns == columns and sorted(r["doc_id"] for r in single.collect()) == sorted(d for d, _, c in brute.components(rows) if d == c)

    clean = staged(stages["secrets"](spark, single, SF), "t")
    scanner, before = Scanner(), {r["doc_id"]: r["text"] for r in single.collect()}
    for r in clean.collect():
        found = brute.secrets(before[r["doc_id"]])
        assert r["n_chars"] == len(r["text"]) and not brute.secrets(r["text"])
        assert found or scanner.spans(before[r["doc_id"]])[1] or r["text"] == before[r["doc_id"]]

    mixed = staged(stages["mixing"](spark, clean, SF), "t")
    sizes, taken = {}, {}
    for frame, into in ((clean, sizes), (mixed, taken)):
        for r in frame.collect():
            into[r["source"]] = into.get(r["source"], 0) + len(brute.words(r["text"]))
    want, longest = brute.targets(sizes), max(len(brute.words(r["text"])) for r in clean.collect())
    assert mixed.columns == columns and all(abs(taken.get(s, 0) - t) <= longest for s, t in want.items())

    packed = stages["packing"](spark, mixed, SF).collect()
    fill = {}
    for r in packed:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    # repeated documents of over half a sequence cannot share one: the total length is no attainable bound here
    assert max(fill.values()) <= 1024 and len(fill) <= brute.fewest_bins([r["length"] for r in packed], 1024) + 2
    assert sum(1 for r in packed if r["piece"] == 0) == mixed.count()
