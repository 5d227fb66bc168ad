import pytest
from pyspark.sql import functions as F

from sluice.sinks import write_table
from sluice.sources import CorruptInputError, list_files, read_table, sink_layout, source_inventory


def test_csv_inference_and_explicit_schema(spark, scratch):
    df = spark.createDataFrame([(1, "a", 2.5)], "id bigint, s string, x double")
    path = scratch("csv")
    write_table(df, path, format="csv", options={"header": "true"})
    inferred = read_table(spark, path, "csv")
    assert dict(inferred.dtypes) == {"id": "int", "s": "string", "x": "double"}  # CSV narrows bigint to int
    typed = read_table(spark, path, "csv", schema=df.schema)
    assert typed.schema == df.schema and typed.first() == df.first()


def test_json_keeps_microseconds_and_rejects_non_json(spark, scratch):
    import datetime as dt

    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 0, 0, 7, 179575))], "id bigint, ts timestamp_ntz")
    path = scratch("json")
    write_table(df, path, format="json")
    assert read_table(spark, path, "json", schema=df.schema).first() == df.first()
    bad = scratch("notjson")
    spark.createDataFrame([("this is not json",)], "value string").write.text(bad)
    with pytest.raises((CorruptInputError, Exception)):
        read_table(spark, bad, "json").collect()


def test_merge_schema_on_parquet(spark, scratch):
    base = scratch("ms")
    write_table(spark.range(3), f"{base}/b=1")
    write_table(spark.range(3).withColumn("extra", F.lit("x")), f"{base}/b=2")
    df = read_table(spark, base, "parquet", merge_schema=True)
    assert set(df.columns) == {"id", "extra", "b"} and df.count() == 6


def test_inventory_groups_by_format_and_skips_markers(spark, scratch):
    base = scratch("inv")
    df = spark.range(10).repartition(2)
    write_table(df, f"{base}/p", format="parquet")
    write_table(df, f"{base}/c", format="csv")
    inv = {r["format"]: r for r in source_inventory(spark, base).collect()}
    assert set(inv) == {"parquet", "csv"}  # _SUCCESS and .crc files are skipped
    assert inv["parquet"]["files"] == 2 and inv["parquet"]["total_bytes"] > 0
    files = list_files(spark, base)
    assert "content" not in files.columns
    layout = sink_layout(spark, base).first()
    assert layout["files"] == 4 and layout["partitions"] == 50


def test_source_file_is_taken_at_the_scan(spark, scratch):
    path = scratch("src")
    write_table(spark.range(10).repartition(2), path)
    df = read_table(spark, path, "parquet", with_source_file=True)
    assert df.select("_source_file").distinct().count() == 2


def test_kafka_without_connector_fails_clearly(spark):
    from sluice.streaming import read_kafka_stream

    with pytest.raises(Exception) as e:
        read_kafka_stream(spark, "localhost:1", "events", "a int")
    assert "kafka" in str(e.value).lower()


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        read_table(spark, "/nowhere", "xlsx")


def test_sampled_inference(spark, scratch):
    path = scratch("sample")
    write_table(spark.range(2000).selectExpr("id", "id * 0.5 AS x"), path, format="csv", options={"header": "true"})
    df = read_table(spark, path, "csv", sampling_ratio=0.1)
    assert dict(df.dtypes) == {"id": "int", "x": "double"} and df.count() == 2000


def test_delta_layout_is_recognised(spark, scratch):
    base = scratch("delta_like")
    write_table(spark.range(5), base)
    spark.createDataFrame([('{"commitInfo": {}}',)], "value string").write.text(f"{base}/_delta_log")
    inv = {r["format"]: r["files"] for r in source_inventory(spark, base).collect()}
    assert "delta" in inv and "parquet" not in inv


def test_jdbc_partitioning_arguments_are_checked(spark):
    from sluice.sources import read_jdbc

    with pytest.raises(ValueError):
        read_jdbc(spark, "jdbc:postgresql://nowhere/db", "t", partition_column="id", lower_bound=0)
