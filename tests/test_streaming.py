import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.streaming import (
    StreamSpec,
    parse_json_messages,
    run_stream_ingest,
    dedupe_within_watermark,
    read_file_stream,
    stream_steps,
    with_time_partition,
    write_stream_files,
    write_time_ordered_files,
)

SCHEMA = "id bigint, ts timestamp_ntz, v double"


def events(spark, n=2000):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(minutes=7 * i), float(i % 13) if i % 10 else None) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_stream_ingest_equals_batch(spark, scratch):
    df = events(spark)
    src = scratch("in")
    assert write_time_ordered_files(df, src, scratch("stage"), "ts", files=4) == 4
    stream = read_file_stream(spark, src, df.schema, max_files_per_trigger=1)
    out, ckpt = scratch("out"), scratch("ckpt")
    res = write_stream_files(with_time_partition(stream, "ts", "day"), out, ckpt, partition_cols=["day"])
    assert res.input_rows == 2000 and res.batches == 4
    back = spark.read.schema(df.schema.add("day", T.StringType())).parquet(out)
    expected = with_time_partition(df, "ts", "day")
    assert back.exceptAll(expected).count() == 0 and expected.exceptAll(back).count() == 0


def test_stream_restart_resumes_from_checkpoint(spark, scratch):
    df = events(spark, 400)
    src, out, ckpt = scratch("in"), scratch("out"), scratch("ckpt")
    write_time_ordered_files(df, src, scratch("stage"), "ts", files=2)
    first = write_stream_files(read_file_stream(spark, src, df.schema), out, ckpt, partition_cols=[])
    again = write_stream_files(read_file_stream(spark, src, df.schema), out, ckpt, partition_cols=[])
    assert first.input_rows == 400 and again.input_rows == 0
    assert spark.read.schema(df.schema).parquet(out).count() == 400


def test_dedupe_within_watermark_and_late_rows(spark, scratch):
    df = events(spark, 1000)
    doubled = df.unionByName(df)
    src = scratch("in")
    write_time_ordered_files(doubled, src, scratch("stage"), "ts", files=4)
    stream = read_file_stream(spark, src, df.schema, max_files_per_trigger=1)
    out, ckpt = scratch("out"), scratch("ckpt")
    res = write_stream_files(dedupe_within_watermark(stream, "id", "ts", "30 minutes"), out, ckpt, partition_cols=[])
    back = spark.read.schema(df.schema).parquet(out)
    assert back.count() == 1000 and res.rows_dropped_by_watermark == 0
    # Files in reverse time order: the watermark moves past earlier files, whose rows are dropped and counted.
    late_src = scratch("late")
    for lo, hi in ((750, 1000), (500, 750), (0, 500)):
        df.filter((F.col("id") >= lo) & (F.col("id") < hi)).coalesce(1).write.mode("append").parquet(late_src)
    out2, ckpt2 = scratch("out"), scratch("ckpt")
    stream2 = read_file_stream(spark, late_src, df.schema, max_files_per_trigger=1)
    res2 = write_stream_files(dedupe_within_watermark(stream2, "id", "ts", "30 minutes"), out2, ckpt2, partition_cols=[])
    kept = spark.read.schema(df.schema).parquet(out2).count()
    assert kept + res2.rows_dropped_by_watermark == 1000 and res2.rows_dropped_by_watermark > 0


def test_dedupe_state_spans_files_and_a_batch_writes_several_files(spark, scratch):
    df = events(spark, 1000)
    again = df.withColumn("ts", F.col("ts") + F.expr("INTERVAL 6 HOURS")).withColumn("v", F.lit(-1.0))
    src = scratch("in")
    write_time_ordered_files(df.unionByName(again), src, scratch("stage"), "ts", files=6)
    spec = StreamSpec(target_path=scratch("out"), checkpoint=scratch("ckpt"), ts_col="ts", grain="day", dedupe_keys=("id",), dedupe_delay="30 hours")
    old = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        res = run_stream_ingest(read_file_stream(spark, src, df.schema, max_files_per_trigger=1), spec)
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", old)
    assert (res.batches, res.input_rows) == (6, 2000)
    back = spark.read.schema(df.schema.add("day", T.StringType())).parquet(spec.target_path)
    assert back.count() == 1000 and back.where("v = -1.0").count() == 0
    assert len(back.inputFiles()) > back.select("day").distinct().count()


def test_malformed_messages_keep_their_text_and_are_no_copies(spark, scratch):
    rows = [(b'{"id": 1, "ts": "2024-01-01T00:00:00", "v": 1.0}',), (b"{cut",), (b"{cut",), (None,)]
    out = parse_json_messages(spark.createDataFrame(rows, "value binary"), SCHEMA).collect()
    assert [r["_corrupt_record"] for r in out] == [None, "{cut", "{cut", None]
    assert out[0]["id"] == 1 and out[1]["id"] is None


def test_stateful_steps_are_refused_on_streams(spark, scratch):
    src = scratch("few")
    events(spark, 10).write.parquet(src)
    stream = read_file_stream(spark, src, SCHEMA)
    with pytest.raises(ValueError):
        stream_steps(stream, ["deduplicate"])
    ok = stream_steps(stream, [{"op": "fill_nulls", "values": {"v": 0.0}}, "add_audit_columns"])
    assert ok.isStreaming


def test_continuous_ingest_query_runs_until_stopped(spark, scratch):
    from sluice.streaming import StreamSpec, start_stream_ingest, stream_result

    df = events(spark, 300)
    src = scratch("in")
    write_time_ordered_files(df, src, scratch("stage"), "ts", files=2, arrive_in_order=False)
    spec = StreamSpec(target_path=scratch("out"), checkpoint=scratch("ckpt"), ts_col="ts", grain="day")
    q = start_stream_ingest(read_file_stream(spark, src, df.schema), spec, processing_time="1 second")
    try:
        q.processAllAvailable()
        assert q.isActive
    finally:
        q.stop()
    assert stream_result(q, spec.target_path, spec.checkpoint).input_rows == 300
    assert spark.read.schema(df.schema.add("day", T.StringType())).parquet(spec.target_path).count() == 300


@pytest.mark.parametrize("keeps_times", [True, False])
def test_files_arrive_in_time_order(spark, scratch, monkeypatch, keeps_times):
    from sluice.streaming import fixtures

    if not keeps_times:  # as on an object store
        monkeypatch.setattr(fixtures, "_keeps_times", lambda *a: False)
    df, jobs = events(spark, 600), []
    for files in (3, 12):
        src = scratch("in")
        spark.sparkContext.setJobGroup(src, "arrivals")
        try:
            assert write_time_ordered_files(df.repartition(5), src, scratch("stage"), "ts", files=files) == files
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(src)))
        back = spark.read.schema(df.schema).parquet(src)
        at = F.col("_metadata.file_modification_time").alias("at")
        ranges = back.groupBy("_metadata.file_path", at).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).orderBy("at").collect()
        assert len(ranges) == files
        for earlier, later in zip(ranges, ranges[1:]):
            assert earlier["at"] < later["at"] and earlier["hi"] < later["lo"]
        assert back.count() == 600 and back.exceptAll(df).count() == 0
    if keeps_times:
        assert jobs[0] == jobs[1]  # one write, not one copy after another
    later = df.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 YEAR"))
    assert write_time_ordered_files(later, src, scratch("stage"), "ts", files=2) == 2  # arrive after those there
    back = spark.read.schema(df.schema).parquet(src).select("ts", F.col("_metadata.file_modification_time").alias("at"))
    first, second = (back.where(w).agg(F.min("at").alias("lo"), F.max("at").alias("hi")).first() for w in ("ts < '2025-01-01'", "ts >= '2025-01-01'"))
    assert back.count() == 1200 and first["hi"] <= second["lo"]


def test_dedupe_keeps_no_more_state_partitions_than_cores(spark, scratch):
    import pathlib

    df = events(spark, 300)
    cores = spark.sparkContext.defaultParallelism
    src, ckpt = scratch("in"), scratch("ckpt")
    write_time_ordered_files(df.unionByName(df), src, scratch("stage"), "ts", files=3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(3 * cores))
    try:
        spec = StreamSpec(target_path=scratch("out"), checkpoint=ckpt, ts_col="ts", grain="day", dedupe_keys=("id",), dedupe_delay="1 hour")
        run_stream_ingest(read_file_stream(spark, src, df.schema, max_files_per_trigger=1), spec)
        assert spark.conf.get("spark.sql.shuffle.partitions") == str(3 * cores)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    stores = [p for p in (pathlib.Path(ckpt.removeprefix("file:")) / "state" / "0").iterdir() if p.name.isdigit()]
    assert len(stores) == cores
    assert spark.read.schema(df.schema.add("day", T.StringType())).parquet(spec.target_path).count() == 300
