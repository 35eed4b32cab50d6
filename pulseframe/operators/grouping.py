"""Groups of events: one each, or by gaps in time with a longest duration."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVENT_FIELDS = ("event_type", "stream", "severity", "time", "detection_latency", "description", "tags")


def event_time() -> Column:
    """When an event began: its time less its detection latency."""
    return F.timestamp_micros(F.unix_micros("time") - F.floor(F.col("detection_latency") / 1000))


def single_groups(events: DataFrame) -> DataFrame:
    """A group for each event, from its own time to its own time."""
    return events.select(event_time().alias("start_time"), event_time().alias("end_time"), F.array(F.struct(*EVENT_FIELDS)).alias("events"))


def gap_islands(events: DataFrame, gap_s: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Events with ms (when they began) and island: a number that changes where more than ``gap_s`` lies after all before.

    With keys, the windows go by key. Without, all events are one sequence,
    and islands are made in two passes: within ranges of time, then over one
    row per range; so no task has to hold the whole sequence.
    """
    rows = events.withColumn("ms", F.unix_millis(event_time()))
    gap = round(gap_s * 1000)
    if keys:
        order = Window.partitionBy(*keys).orderBy("ms", "stream", "event_type")
        new = (F.col("ms") - F.lag("ms").over(order) > gap).cast("long")
        return rows.withColumn("_new", F.coalesce(new, F.lit(1))).withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    width = max(1, 1000 * gap)  # a range in time; what begins one range is held against the last of the ranges before
    rows = rows.withColumn("_range", F.floor(F.col("ms") / width))
    ends = rows.groupBy("_range").agg(F.max("ms").alias("_end"))
    ends = ends.withColumn("_before", F.max("_end").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))).select("_range", "_before")
    rows = rows.join(ends, "_range")
    order = Window.partitionBy("_range").orderBy("ms", "stream", "event_type")
    new = F.coalesce(F.col("ms") - F.coalesce(F.lag("ms").over(order), F.col("_before")) > gap, F.lit(True))
    rows = rows.withColumn("_new", new)
    # an island is known by where it starts
    start = F.max(F.when(F.col("_new"), F.col("ms"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_start", start)
    starts = rows.groupBy("_range").agg(F.max(F.when(F.col("_new"), F.col("ms"))).alias("_s")).withColumn("_carried", F.max("_s").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))).select("_range", "_carried")
    return rows.join(starts, "_range").withColumn("island", F.coalesce("_start", "_carried")).drop("_range", "_before", "_new", "_start", "_carried")


def _group(rows: DataFrame, by: list[str], keys: tuple[str, ...]) -> DataFrame:
    out = rows.groupBy(*by).agg(F.min("ms").alias("_s"), F.max("ms").alias("_e"), F.array_sort(F.collect_list(F.struct("ms", "time", "stream", "event_type", "severity", "detection_latency", "description", F.map_entries("tags").alias("tags")))).alias("_events"))
    events = F.transform("_events", lambda e: F.struct(*(e[c].alias(c) if c != "tags" else F.map_from_entries(e[c]).alias(c) for c in EVENT_FIELDS)))
    return out.select(*keys, F.timestamp_millis("_s").alias("start_time"), F.timestamp_millis("_e").alias("end_time"), events.alias("events"))


def temporal_groups(events: DataFrame, gap_s: float = 10, longest_s: float | None = 7200, keys: tuple[str, ...] = ()) -> DataFrame:
    """Groups of events with at most ``gap_s`` between them and none over ``longest_s`` long.

    The gaps are found by windows; only within an island, which a gap closes
    anyway, is the sequence cut at the longest duration, by reading it in
    order. Open groups at the end of the input are closed there.
    """
    rows = gap_islands(events, gap_s, keys)
    if longest_s is None:
        return _group(rows, [*keys, "island"], keys)
    longest = round(longest_s * 1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, start, part = None, 0, 0
        for b in batches:
            parts = []
            for key, ms in zip(zip(*(b.column(c).to_pylist() for c in (*keys, "island")), strict=True), b.column("ms").to_pylist(), strict=True):
                if key != last:
                    last, start, part = key, ms, 0
                elif ms - start > longest:
                    start, part = ms, part + 1
                parts.append(part)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(parts, pa.int64())], names=[*b.schema.names, "part"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in rows.columns) + ", part long"
    cut = rows.repartition(*keys, "island").sortWithinPartitions(*keys, "island", "ms", "stream", "event_type").mapInArrow(run, schema)
    return _group(cut, [*keys, "island", "part"], keys)


def with_uid(groups: DataFrame) -> DataFrame:
    """Groups with a name made of what they hold, so that a retry gives the same."""
    members = F.transform("events", lambda e: F.concat_ws("|", e["stream"], e["event_type"], F.unix_micros(e["time"]).cast("string"), e["severity"].cast("string"), e["description"]))
    h = F.sha2(F.concat_ws("\n", F.unix_micros("start_time").cast("string"), F.array_join(members, "\n")), 256)
    return groups.withColumn("uid", F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))))


def in_group(groups: DataFrame) -> DataFrame:
    """The events of groups with a uid, tagged with it."""
    rows = groups.select("uid", F.explode("events").alias("e"))
    tags = F.map_concat("e.tags", F.create_map(F.lit("in_group"), F.col("uid")))
    return rows.select(*(f"e.{c}" for c in EVENT_FIELDS[:-1]), tags.alias("tags"))


def aggregates(groups: DataFrame) -> DataFrame:
    """Of each group: the commonest event type (the smallest of equals), streams, mean severity (whole), mean latency in ns (whole), events, seconds."""
    kinds = F.transform(F.array_distinct(F.col("events.event_type")), lambda k: F.struct((-F.size(F.filter(F.col("events.event_type"), lambda x: x == k))).alias("n"), k.alias("k")))
    total = lambda c: F.aggregate(F.col(f"events.{c}"), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    n = F.size("events")
    return groups.withColumns({
        "mode_event_type": F.array_min(kinds)["k"], "stream_count": F.size(F.array_distinct("events.stream")), "event_count": n,
        "mean_severity": F.floor(total("severity") / n).cast("int"), "mean_detection_latency": F.floor(total("detection_latency") / n).cast("long"),
        "duration_s": (F.unix_millis("end_time") - F.unix_millis("start_time")) / 1000,
    })
