"""Streams give what batches give, over several files and a restart between them."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pulseframe.operators import detectors as D
from pulseframe.operators import runtime, suppress
from pulseframe.schemas import EVENT, MEASUREMENT
from pulseframe.streaming import runtime as S

START = datetime(2024, 1, 1)
KEY = ("event_type", "stream", "time", "severity", "detection_latency")


def measurements(spark, n=120):
    rows = [(s, START + timedelta(seconds=i), i, float((i * 7919) % 251) if i < n // 2 else 4000.0 + i, (i * 31) % 5 == 0) for s in "ab" for i in range(n)]
    return spark.createDataFrame(rows, MEASUREMENT)


def in_parts(spark, df, folder, by):
    """The rows as one file for each third of the time, written between the runs."""
    parts = [df.where(by == i) for i in range(3)]
    source = str(folder / "in")
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(source)
        yield source


def run_all(spark, df, folder, build, by):
    out, check = str(folder / "out"), str(folder / "check")
    for source in in_parts(spark, df, folder, by):
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
        q = build(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(out)


def keys(df):
    return sorted(tuple(r[c] for c in KEY) for r in df.collect())


def third():
    return F.floor((F.unix_seconds("time") - F.lit(int(START.timestamp()))) / 40)


@pytest.mark.parametrize("detector", [D.Baseline(10, 0.1, 5), D.Loss(10, 3, 1)])
def test_streams_and_restarts_give_what_batches_give(spark, tmp_path, detector):
    m = measurements(spark)
    got = run_all(spark, m, tmp_path, lambda s: S.detect_stream(s, detector), third())
    want = keys(runtime.detect(m, detector))
    assert want and keys(got) == want


def test_windows_put_late_rows_in_order(spark, tmp_path):
    m = measurements(spark)
    detector = D.Loss(10, 3, 1)
    # rows come in the wrong order across files, but within a window of a minute
    by = (F.col("seq") * 7 % 3).cast("long")
    flush = spark.createDataFrame([("z", START + timedelta(hours=1), 0, 1.0, False)], MEASUREMENT)
    got = run_all(spark, m.unionByName(flush), tmp_path, lambda s: S.detect_stream(s, detector, 60, "200 seconds"), F.when(F.col("stream") == "z", 2).otherwise(by))
    assert keys(got) == keys(runtime.detect(m, detector))


def test_suppression_of_a_stream(spark, tmp_path):
    e = spark.createDataFrame([("k", "s", 10, START + timedelta(seconds=s), 0, "d", {}) for s in range(0, 90, 4)], EVENT)
    got = run_all(spark, e, tmp_path, S.suppress_stream, F.least(F.floor((F.unix_seconds("time") - F.lit(int(START.timestamp()))) / 30), F.lit(2)))
    assert keys(got) == keys(suppress.suppress(e))


def test_groups_close_with_the_watermark(spark, tmp_path):
    seconds = [0, 1, 2, 100, 101, 500, 900]
    e = spark.createDataFrame([("k", "s", 10, START + timedelta(seconds=s), 0, "d", {}) for s in seconds], EVENT)
    by = F.when(F.col("time") < F.lit(START + timedelta(seconds=50)), 0).when(F.col("time") < F.lit(START + timedelta(seconds=400)), 1).otherwise(2)
    got = run_all(spark, e, tmp_path, lambda s: S.group_stream(s, 10, 7200), by)
    spans = sorted(((r.start_time - START).seconds, (r.end_time - START).seconds) for r in got.collect())
    assert (0, 2) in spans and (100, 101) in spans and len(spans) == len(set(spans))


FLOW = """
sources:
  m: {type: parquet, config: {path: PATH}}
sinks:
  lines: {type: influx}
  table: {type: parquet}
detectors:
  lost:
    type: loss
    instances:
      - source: [{name: m, datatype: icmp}]
        sink: [{name: lines}, {name: table}]
        config: {maxHistory: 10, lossCount: 3, consecutiveCount: 1, useFlinkTimeWindow: false}
  base:
    type: baseline
    instances:
      - source: [{name: m, datatype: icmp, filterLossy: true}]
        sink: [{name: lines}]
        config: {maxHistory: 10, percentile: 0.1, threshold: 5, windowDuration: 30}
"""


def lines_of(folder):
    return sorted(x for p in folder.rglob("part-*.txt") for x in p.read_text().splitlines())


def test_a_streaming_flow_with_restarts_gives_what_the_batch_flow_gives(spark, tmp_path):
    """Detectors with and without windows, suppression, groups and sinks; the flow is started anew for each file."""
    from pulseframe.plans import dag

    m = measurements(spark)
    flow = lambda source: dag.parse(FLOW.replace("PATH", str(source)))
    # a late stretch on a stream of its own makes the watermark pass all that came before; what it gives itself stays open
    late = [("late", START + timedelta(hours=5 + h), i, 100.0, i % 4 == 0) for h in range(2) for i in range(40)]
    late = [(s, t + timedelta(seconds=i), i, v, x) for s, t, i, v, x in late]
    flush = spark.createDataFrame(late, MEASUREMENT)
    whole = m.unionByName(flush)
    whole.coalesce(1).write.parquet(str(tmp_path / "whole"))
    dag.Builder(spark).run(flow(tmp_path / "whole"), str(tmp_path / "batch"))

    source = tmp_path / "parts"
    parts = [m.where(third() == i) for i in range(3)] + [flush.where(F.hour("time") < 6), flush.where(F.hour("time") >= 6)]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(str(source))
        dag.Builder(spark, stream=True).start(flow(source), str(tmp_path / "stream"), once=True)
    with pytest.raises(ValueError, match="start"):
        dag.Builder(spark, stream=True).run(flow(source), str(tmp_path / "stream"))

    known = lambda xs: [x for x in xs if "stream=late" not in x]
    events = {k: known(lines_of(tmp_path / k / "lines/events")) for k in ("batch", "stream")}
    assert len(events["batch"]) > 20 and events["stream"] == events["batch"]
    table = {k: keys(spark.read.parquet(str(tmp_path / k / "table")).where("stream <> 'late'")) for k in ("batch", "stream")}
    assert table["batch"] and table["stream"] == table["batch"]
    early = lambda xs: [x for x in xs if int(x.rsplit(" ", 1)[1]) < (START.timestamp() + 3600) * 1e9]
    groups = {k: early(lines_of(tmp_path / k / "lines/event_groups")) for k in ("batch", "stream")}
    assert groups["batch"] and groups["stream"] == groups["batch"]
    inside = {k: known(lines_of(tmp_path / k / "lines/events_in_groups")) for k in ("batch", "stream")}
    assert inside["batch"] and inside["stream"] == inside["batch"]


class State(dict):
    """A state store in memory that counts its calls; as a value it is the entry None."""

    calls = 0

    def exists(self):
        return None in self

    def get(self):
        return self[None]

    def update(self, value):
        self[None] = value

    def updateValue(self, key, value):
        self.calls, self[key] = self.calls + 1, value

    def getValue(self, key):
        return self[key]

    def removeKey(self, key):
        del self[key]


class Handle:
    def __init__(self):
        self.value, self.held, self.timers = State(), State(), []

    def getValueState(self, name, schema):
        return self.value

    def getMapState(self, name, key, value):
        return self.held

    def registerTimer(self, at):
        self.timers.append(at)

    getCurrentWatermarkInMs = lambda self: 0


def test_held_rows_cost_a_timer_and_a_part_a_window_and_stay_out_of_the_json(spark):
    """One row of a stream in an Arrow batch, and each window's rows read once, in order."""
    df = spark.createDataFrame([("a" if i % 3 else None, (i * 7919) % 5000, i, None if i % 10 == 0 else float(i), i % 4 == 0) for i in range(5000)], "stream string, ms long, seq long, value double, is_lossy boolean")
    frames = S.packed(df.coalesce(1)).toPandas()
    assert len(frames) == 2 and frames["stream"].isna().sum() == 1
    handle, seen = Handle(), []

    class Seen(D.Loss):
        def step(self, state, t, value, lossy):
            seen.append((t, value, lossy))
            return []

    p = S.DetectorProcessor(Seen(), 1000)
    p.init(handle)
    one = frames[frames["stream"] == "a"]
    assert list(p.handleInputRows(("a",), iter([one]), handle)) == []
    assert handle.timers == [1000, 2000, 3000, 4000, 5000] and handle.held.calls == 5 and len(handle.value[None][0]) < 500
    for end in handle.timers:
        list(p.handleExpiredTimer(("a",), handle, type("Expired", (), {"getExpiryTimeInMs": lambda self, end=end: end})()))
    assert seen == sorted((r.ms, r.value, r.is_lossy) for r in df.where("stream = 'a'").collect()) and not handle.held
