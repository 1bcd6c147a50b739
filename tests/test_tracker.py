"""The tracker on a stream against its batch form after a restart, and its step with timeouts."""

import datetime as dt

import pandas as pd

from lodestar import catalog
from lodestar.streaming.tracker import count_windows, stepper
from lodestar.streaming.twins import read_events


class State:
    """What a step uses of a group's state."""

    def __init__(self):
        self.value, self.hasTimedOut, self.wait = None, False, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, ms):
        self.wait = ms


def batch(first, n):
    return pd.DataFrame({"ts": range(first, first + n), "event_id": range(first, first + n), "value": [None if i == first else float(i) for i in range(first, first + n)], "event_type": ["error" if i % 2 else "view" for i in range(first, first + n)]})


def test_steps_and_timeouts():
    step, state = stepper(10, 1500, 9000), State()
    run = lambda *batches: [tuple(r) for out in step((7,), iter(batches), state) for r in out.itertuples(index=False)]
    assert run(batch(4, 9), batch(0, 4)) == [(7, 0, 10, 5.125, 5, True)]  # by time, not by arrival; two values are missing
    assert state.value[:2] == (1, 3) and state.wait == 1500
    state.hasTimedOut = True
    assert run() == [(7, 1, 3, 11.0, 1, False)]
    assert state.wait == 9000 and state.exists
    assert run() == [] and not state.exists
    state.hasTimedOut = False
    assert [r[1:3] for r in run(batch(0, 20))] == [(0, 10), (1, 10)] and state.wait == 9000


def test_stream_equals_the_batch_form_after_a_restart(spark, tmp_path):
    schema = "user_id long, ts timestamp, event_id long, value double, event_type string"
    at = lambda i: dt.datetime(2024, 1, 1, 0, i)
    rows = [(u, at(i), 100 * u + i, float(i * u), "error" if i % 3 == 0 else "view") for i in range(36) for u in (1, 2)] + [(None, at(1), 1, 1.0, "view")]
    for part, until in (((0, 17), "first"), ((17, 36), "second")):
        frame = spark.createDataFrame([r for r in rows if part[0] <= r[1].minute < part[1]], schema)
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = count_windows(read_events(spark, str(tmp_path / "in"), frame.schema))
        running = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        assert running.awaitTermination(90), until
    events = spark.createDataFrame(rows, schema).where("user_id is not null")
    twin = catalog.apply("EVL18_rolling_tracker", spark, {"events": events}).where("queries = 10").select("user_id", "window_no", "queries", "mean_latency", "failures")
    found = spark.read.parquet(str(tmp_path / "out")).where("full").select(*twin.columns)
    assert sorted(found.collect()) == sorted(twin.collect()) and found.count() == 6
