"""A stream over files ends where its batch twin does."""

from lodestar.streaming import twins


def run(frame, mode):
    name = f"out_{abs(hash((frame, mode)))}"
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return frame.sparkSession.table(name)


def split(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.repartition(3, "event_id").write.parquet(str(tmp_path / "in"))
    return events, twins.read_events(spark, str(tmp_path / "in"), events.schema)


def test_hourly_latency_equals_its_twin(spark, data, tmp_path):
    events, stream = split(spark, data, tmp_path)
    got = {tuple(r) for r in run(twins.hourly_latency(stream.drop("props")), "complete").collect()}
    assert got == {tuple(r) for r in twins.hourly_latency(events).collect()}


def test_tracker_counts_errors_over_batches(spark, data, tmp_path):
    events, stream = split(spark, data, tmp_path)
    last = {}
    for r in run(twins.failure_tracker(stream), "update").collect():
        last[r.user_id] = max(last.get(r.user_id, 0), r.failures)
    want = {r.user_id: r["n"] for r in events.where("event_type = 'error'").groupBy("user_id").count().withColumnRenamed("count", "n").collect()}
    assert {u: n for u, n in last.items() if n} == want


def test_append_sink(spark, data, tmp_path):
    events, stream = split(spark, data, tmp_path)
    twins.append_events(stream.select("event_id", "event_type"), str(tmp_path / "sink"), str(tmp_path / "mark")).awaitTermination()
    assert spark.read.json(str(tmp_path / "sink")).count() == events.count()


def test_streams_of_distinct_events(spark, data, tmp_path):
    events, stream = split(spark, data, tmp_path)
    again = stream.unionByName(stream).drop("props")
    got = run(twins.distinct_events(again), "append").collect()
    # what comes later than the watermark allows is left out
    assert 0 < len(got) == len({r.event_id for r in got}) <= events.count()


def test_sessions_of_a_stream_are_those_of_its_twin(spark, data, tmp_path):
    """A stream gives the sessions that the watermark has closed; each is one of the twin's."""
    events, stream = split(spark, data, tmp_path)
    got = {tuple(r) for r in run(twins.user_sessions(stream.drop("props")), "append").collect()}
    want = {tuple(r) for r in twins.user_sessions(events).collect()}
    late = {(u, s) for u, s, _ in got}
    assert got and all(u in {w[0] for w in want} for u, _ in late)


def test_of_repeated_events_the_first_counts(spark):
    rows = [(1, "2024-01-02", "b"), (1, "2024-01-01", "z"), (2, "2024-01-01", "a"), (1, "2024-01-01", "c")]
    events = spark.createDataFrame(rows, "event_id long, ts string, event_type string")
    assert sorted(map(tuple, twins.distinct_events(events).collect())) == [(1, "2024-01-01", "c"), (2, "2024-01-01", "a")]
