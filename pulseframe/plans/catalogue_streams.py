"""Queries that run as streams over files that come one by one, and end when they have caught up; the SQL is that of the batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pulseframe.operators import detectors as D
from pulseframe.operators import grouping, runtime, suppress, windows
from pulseframe.operators.scratch import discard, fresh, scratch
from pulseframe.plans.catalogue import BASELINE, GAPS, ORACLE_SQL, WEEK, measurements, plain, query
from pulseframe.streaming import runtime as streaming

DAY = 86400


def followed(spark: SparkSession, df: DataFrame, build: Callable[[DataFrame], DataFrame], order: Column | None = None) -> DataFrame:
    """What build makes of df as a stream: a file for each ten days, in ``order`` within, then one late row, which lets the watermark pass all others.

    df is read once, and dealt to its ten days; each file is made of its own.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streaming.STATE_STORE)
    staged, path, out, state = (scratch(spark, name) for name in ("stream-staged", "stream-in", "stream-out", "stream-state"))
    (part,) = fresh(df, "part")
    df.where("time is not null").withColumn(part, F.floor(F.unix_seconds("time") / (10 * DAY))).write.partitionBy(part).parquet(staged)
    rows = spark.read.schema(StructType([*df.schema, StructField(part, LongType())])).parquet(staged)
    for p in sorted(r[0] for r in rows.select(part).distinct().collect()):
        some = rows.where(F.col(part) == p).select(*df.columns)
        (some if order is None else some.orderBy(order)).coalesce(1).write.mode("append").parquet(path)
    _after(rows.select(*df.columns)).coalesce(1).write.mode("append").parquet(path)
    found = build(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path))
    writer = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
    writer.trigger(availableNow=True).start().awaitTermination()
    discard(spark, staged, path, state)
    return spark.read.schema(found.schema).parquet(out)


def _after(df: DataFrame) -> DataFrame:
    """One row ten days after the last, of a stream of its own."""
    row = df.orderBy(F.desc("time")).limit(1)
    row = row.withColumns({"time": F.timestamp_seconds(F.unix_seconds("time") + 10 * DAY), "stream": F.lit("after")})
    return row.select(*df.columns)


@query("stream_baseline", BASELINE)
def stream_baseline(spark, sf):
    m = runtime.not_lossy(measurements(spark, sf))
    detector = D.Baseline(threshold=5, inactivity=WEEK)
    return plain(followed(spark, m, lambda s: streaming.detect_stream(s, detector)))


@query("window_wrapper_tumbling", BASELINE)
def window_wrapper_tumbling(spark, sf):
    """The detector fed by windows of a day, in order of time within each."""
    m = runtime.not_lossy(measurements(spark, sf))
    detector = D.Baseline(threshold=5, inactivity=WEEK)
    # files in an order of their own, so that only the windows put rows in order
    return plain(followed(spark, m, lambda s: streaming.detect_stream(s, detector, DAY, "1 hour"), F.xxhash64("seq")))


@query("stream_suppress", ORACLE_SQL["frequent_filter"])
def stream_suppress(spark, sf):
    events = windows.threshold_events(measurements(spark, sf), 10)
    own = (suppress.Frequency("own", 3600, 3, 7200, 25),)
    return plain(followed(spark, events, lambda s: streaming.suppress_stream(s, own))).where("stream <> 'after'")


@query("stream_groups", f"WITH {GAPS} SELECT min(ms) AS start_ms, max(ms) AS end_ms, count(*)::INTEGER AS events FROM i GROUP BY island")
def stream_groups(spark, sf):
    events = windows.threshold_events(measurements(spark, sf), 50)
    found = followed(spark, events, lambda s: streaming.group_stream(s, 600, 365 * DAY))
    groups = grouping.aggregates(streaming.as_groups(found))
    return groups.select(F.unix_millis("start_time").alias("start_ms"), F.unix_millis("end_time").alias("end_ms"), F.col("event_count").alias("events"))
