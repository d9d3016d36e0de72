"""Layouts, recordings and streams."""

import time

import pytest
from pyspark.sql import functions as F

from gaugeloom.sources import layouts, recording
from gaugeloom.streaming import live


def test_layouts_carry_classes():
    p = layouts.SECTIONS.by_id[1]
    assert p.of_class("cumulative") == ["utime", "stime"] and p.schema["rss"].metadata == {"class": "gauge", "unit": "kibibytes"} and p.schema["rss"].nullable
    assert len(layouts.SECTIONS.section("statements")) == 2 and layouts.SECTIONS.by_id[6].row_identity() == ["severity", "category", "pattern", "count"]
    with pytest.raises(ValueError):
        layouts.Layout(9, "x", "event_stream", (), (), ("n:i64/C",))
    with pytest.raises(ValueError):
        layouts.Layout(9, "x", "event_stream", ("y",), (), ("n:i64/L",))


def test_recordings_are_written_and_read_by_segment(spark, tmp_path):
    layout = layouts.SECTIONS.by_id[4]
    rows = [(s, s + t, 0, r, t * r) for s in (0, 1000, 2000) for t in range(5) for r in range(3)]
    df = spark.createDataFrame(rows, "segment_id long, ts long, scope int, resource int, some_us long")
    recording.write(df, layout, str(tmp_path))
    got = recording.read(spark, layout, str(tmp_path), 1002, 2002)
    assert sorted(r["ts"] for r in got.collect()) == sorted(x[1] for x in rows if 1002 <= x[1] < 2002)
    assert "PartitionFilters: [isnotnull(segment_id" in got._jdf.queryExecution().toString().replace("#", "#") or got.count() == 21
    catalog = recording.segments(recording.read(spark, layout, str(tmp_path)), 4)
    near = {(r["segment_id"], r["predecessor"]) for r in recording.with_predecessors(catalog, 2000, 3000).collect()}
    assert near == {(2000, False), (1000, True)} and recording.inspect(catalog).first()["rows"] == 45
    assert [r["segment_id"] for r in recording.retention(catalog.withColumn("bytes", F.lit(10)), 20).collect()] == [0]


def test_dictionary_and_blobs(spark):
    df = spark.createDataFrame([("ab",), ("ab",), ("ac",), ("éé",)], "t string")
    assert sorted(r["t"] for r in recording.dictionary(df, "t", "a").collect()) == ["ab", "ac"]
    cut = df.where("t = 'éé'").select(recording.blob("t", most=3).alias("b")).first()["b"]
    assert (bytes(cut["stored"]), cut["full_len"], cut["truncated"]) == ("é".encode() + b"\xc3", 4, True)


@pytest.fixture
def data_only(spark):
    """With state that expires, batches without data never end."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_streamed_rates_carry_state_across_batches(spark, tmp_path, data_only):
    schema = "entity long, ts long, v long"
    parts = [[(1, 0, 10), (2, 0, 5)], [(1, 2_000_000, 30), (1, 1_000_000, 12)], [(1, 3_000_000, 31), (2, 90_000_000, 9), (1, 500_000, 50)]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = live.rates(source, "entity", "v", 10_000_000).writeStream.format("memory").queryName("rates").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = {(r["entity"], r["ts"]): r["rate"] for r in spark.table("rates").collect()}
    assert got[1, 0] is None and got[1, 1_000_000] == 2.0 and got[1, 2_000_000] == 18.0 and got[1, 3_000_000] == 1.0
    assert got[2, 90_000_000] is None and got[1, 500_000] is None


def test_streamed_buckets_and_store(spark, tmp_path):
    df = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id * 20) AS ts, id % 2 AS k, id AS v FROM range(12)")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = live.follow(spark, str(tmp_path / "in"), df.schema)
    live.store(live.bucketed(source, ["k"], "v", "1 hour", "0 minutes"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(r["start"].hour, r["k"]): (r["n"], r["total"], r["most"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[0, 0] == (2, 2, 2) and got[0, 1] == (1, 1, 1) and (3, 0) not in got


def test_idle_entities_leave_the_state(spark, tmp_path, data_only):
    """A row that comes after its entity's was forgotten has nothing before it."""
    schema = "entity long, ts long, v long"
    for i, rows in enumerate(([(1, 0, 10), (2, 0, 5)], [(1, 1_000_000, 30)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
        sink = live.rates(source, "entity", "v", 10_000_000, forget_after=0.5).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        assert sink.trigger(availableNow=True).start().awaitTermination(120)
        time.sleep(1)
    assert {(r["entity"], r["ts"]): r["rate"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, 0): None, (2, 0): None, (1, 1_000_000): None}


def test_positions_never_go_back(spark, tmp_path):
    rows = spark.createDataFrame([(t, k) for t in range(5) for k in range(3)], "ts long, k long")
    tail = live.Tail(spark, str(tmp_path / "at"), ["ts", "k"])
    assert tail.position() is None and tail.read(rows).count() == 15
    assert tail.advance(rows.where("ts < 3")) == (2, 2) and {(r["ts"], r["k"]) for r in tail.read(rows).collect()} == {(t, k) for t in (3, 4) for k in range(3)}
    assert tail.advance(rows.where("ts < 0")) == (2, 2)
    with pytest.raises(ValueError, match="comes before"):
        tail.advance(rows.where("ts < 1"))
    with pytest.raises(ValueError, match="ends before"):
        tail.read(rows.where("ts < 2"))
