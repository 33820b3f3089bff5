from kestrel.streaming import rollups

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(SF)
    found = rollups.rollup(stream, lateness="60 days")
    query = found.writeStream.format("memory").queryName("rolled").outputMode("complete").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    assert query.awaitTermination(90)
    key = lambda r: (r.start, r.event_type)
    got, want = (sorted(df.collect(), key=key) for df in (spark.table("rolled"), rollups.rollup(batch)))
    assert [(r.start, r.event_type, r.events, round(r.mean_value, 6)) for r in got] == [(r.start, r.event_type, r.events, round(r.mean_value, 6)) for r in want] and got


def test_bursts(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, t), (1, t + dt.timedelta(seconds=1)), (1, t + dt.timedelta(seconds=9)), (2, None)], "user_id long, ts timestamp")
    assert sorted((r.user_id, r.events) for r in rollups.bursts(rows).collect()) == [(1, 1), (1, 2)]
