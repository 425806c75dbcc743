"""Streams over files, against their batch twins."""

import json

from pyspark.sql import functions as F

from folioform.streaming import windows

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
SRC = "/root/testdata/sf0.001"


def test_tumbling_stream_equals_batch(spark, tmp_path):
    ev = spark.read.parquet(f"{SRC}/events.parquet")
    ev.write.parquet(str(tmp_path / "in"))
    q = windows.tumbling(windows.read_events(spark, str(tmp_path / "in"), SCHEMA), "ts", "1 day", ["event_type"]).writeStream.outputMode("complete").format("memory").queryName("tw").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = windows.tumbling(ev, "ts", "1 day", ["event_type"])
    assert sorted(map(repr, spark.table("tw").select("win_start", "event_type", "n").collect())) == sorted(map(repr, batch.select("win_start", "event_type", "n").collect()))


def test_token_bucket():
    ok, tokens, last = windows.allow([0, 0, 0, 1.0, 1.2, 9], 2, 1.0, 2.0, None)
    assert ok == [True, True, False, True, False, True] and last == 9


def test_token_bucket_stream(spark, tmp_path):
    spark.createDataFrame([(i, "k", 1_700_000_000 + i // 4) for i in range(12)], "event_id long, k string, s long").select("event_id", "k", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("event_id long, k string, ts timestamp").parquet(str(tmp_path / "in"))
    q = windows.token_bucket(src, "k", "ts", 3, 1.0).writeStream.outputMode("append").format("memory").queryName("tb").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert spark.table("tb").where("allowed").count() == 5 and spark.table("tb").count() == 12


def test_transcripts_and_states(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text("".join(json.dumps({"t": t, "seq": i, "engine_id": "e"}) + "\n" for i, t in enumerate(["ENGINE_INFO", "WARN", "ERROR"])) + "broken\n")
    df = windows.read_transcripts(spark, str(tmp_path)).where("t IS NOT NULL")
    assert df.count() == 3
    assert windows.job_states(df, "engine_id", ["seq"], "t").first().t == "ERROR"
    assert windows.dedup_stream(df.withColumn("ts", F.current_timestamp()), "ts", ["engine_id"]).count() == 1
