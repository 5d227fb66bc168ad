"""Each query with SQL against DuckDB on whole sf0.001, and on a table of hard cases."""

import duckdb
import pytest
from test_conversations import SCHEMA, talk

from sluice.llm.conversations import audit_conversations, damage
from sluice.llm.jaccard import jaccard_components
from sluice.llm.oracle import oracle_sql
from sluice.llm.queries import QUERIES
from sluice.llm.resampling import resample
from sluice.llm.substrings import remove_repeated_windows
from sluice.llm.suffixes import remove_repeated_strings

SF = "/root/testdata/sf0.001"


def answer(con, name):
    rel = con.sql(oracle_sql()[name])
    order = sorted(range(len(rel.columns)), key=rel.columns.__getitem__)
    return sorted(rel.columns), sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=repr)


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql_on_given_tables(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    assert rows_of(QUERIES[name](spark, SF)) == answer(con, name)


def test_sql_on_hard_cases(spark):
    """Nulls, blanks, odd characters, ties; ids are unique here, since the SQL joins on them."""
    texts = [None, "", " \t\n", "a", "A b c d", "a B\tc\vd", "é" * 60, "x" * 49, "x" * 50, "x" * 120, "x y " * 30, "語 12-ab_cd\x7f{E}", " ".join(f"w{i}" for i in range(30)), "pre " + " ".join(f"W{i}" for i in range(30)), " ".join(f"w{i}" for i in range(29)) + " post"]
    docs = [(i * 3 - 4, t) for i, t in enumerate(texts + texts[6:])]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.execute("CREATE TABLE benchmark AS SELECT 1::BIGINT AS item_id, 'w1 w2 W3 é' AS text UNION ALL SELECT 2, NULL")
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    target = spark.createDataFrame([("w1 w2 W3 é",), (None,)], "text string")
    small = {"block_bytes": 300, "bucket_bytes": 500}
    assert rows_of(remove_repeated_strings(frame, **small).drop("kept")) == answer(con, "op1_suffixes")
    assert rows_of(jaccard_components(frame, **small).select("doc_id", "n_shingles", "component_id")) == answer(con, "op4_jaccard")
    assert rows_of(remove_repeated_windows(frame, **small).drop("intervals", "kept_text")) == answer(con, "op6_substrings")
    assert rows_of(resample(frame, target).select("doc_id", "n_features", "weight", "score", "rank")) == answer(con, "op11_resampling")


def test_sql_on_hard_conversations(spark):
    rows = [r for r in talk() if r[0] != 7000]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    frame = spark.createDataFrame([("n", t, r, c, k, 1, "c", "k") for c, k, r, t in rows], SCHEMA)
    assert rows_of(audit_conversations(damage(frame), frame)) == answer(con, "op13_conversations")
