"""What windows and expressions can say of the detectors, metrics and joins: these stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.functions.severity import severity_col
from pulseframe.functions.text import bound
from pulseframe.operators.scratch import written
from pulseframe.schemas import EVENT_COLUMNS

ORDER = ("time", "seq")


def _event(df: DataFrame, kind: str, severity: Column, latency: Column, description: Column, tags: Column | None = None) -> DataFrame:
    none = F.create_map().cast("map<string,string>")
    return df.select(F.lit(kind).alias("event_type"), "stream", severity.cast("int").alias("severity"), "time", latency.cast("long").alias("detection_latency"), description.alias("description"), (none if tags is None else tags).alias("tags")).select(*EVENT_COLUMNS)


def threshold_events(df: DataFrame, threshold: float = 1000.0) -> DataFrame:
    return _event(df.where(F.col("value") > threshold), "threshold_events", F.lit(10), F.lit(0), F.concat(F.lit("Value was "), F.col("value").cast("string")))


def percentile_of(sorted_values: Column, percent: float) -> Column:
    """The detectors' estimate from a sorted array: at percent * (n + 1) / 100 between its values, ends held."""
    n = F.size(sorted_values)
    at = F.lit(percent) * (n + 1) / 100
    k = F.floor(at).cast("int")
    below = F.try_element_at(sorted_values, F.greatest(k, F.lit(1)))
    above = F.try_element_at(sorted_values, F.least(k + 1, n))
    return F.when(at < 1, F.try_element_at(sorted_values, F.lit(1))).when(at >= n, F.try_element_at(sorted_values, n)).otherwise(below + (at - k) * (above - below))


def baseline_steps(df: DataFrame, max_history: int = 50, percentile: float = 0.10) -> DataFrame:
    """Not-lossy rows with n (values so far, up to max_history), result and previous, for streams without purges.

    Where the percentile falls before the first of max_history values it is
    the rolling least, which needs no array.
    """
    order = Window.partitionBy("stream").orderBy(*ORDER)
    frame = order.rowsBetween(1 - max_history, 0)
    if percentile * (max_history + 1) / 100 < 1:
        result = F.min("value").over(frame)
    else:
        result = bound(F.sort_array(F.collect_list("value").over(frame)), lambda v: percentile_of(v, percentile))  # array_sort would call a comparison a pair
    rows = df.where(~F.col("is_lossy") & F.col("value").isNotNull()).withColumns({"n": F.count("value").over(frame), "result": result})
    return rows.withColumn("previous", F.lag("result", 1, 0.0).over(order))


def baseline_events(df: DataFrame, max_history: int = 50, percentile: float = 0.10, threshold: int = 25) -> DataFrame:
    rows = baseline_steps(df, max_history, percentile).withColumn("s", severity_col(F.col("previous"), F.col("result"))).where((F.col("n") >= max_history) & (F.col("s") > threshold))
    text = F.concat(F.lit("Observed baseline changed from "), F.col("previous").cast("string"), F.lit(" to "), F.col("result").cast("string"))
    return _event(rows, "baseline_events", F.col("s"), F.lit(0), text)


def loss_steps(df: DataFrame, max_history: int = 30) -> DataFrame:
    """Each row with its lost count of the last max_history, that of the window before it came, and its run of loss."""
    order = Window.partitionBy("stream").orderBy(*ORDER)
    lost = F.col("is_lossy").cast("int")
    rows = df.withColumns({
        "lost": F.sum(lost).over(order.rowsBetween(1 - max_history, 0)),
        "before": F.coalesce(F.sum(lost).over(order.rowsBetween(-max_history, -1)), F.lit(0)),
        "island": F.sum(1 - lost).over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "here": F.row_number().over(order),
    })
    run = Window.partitionBy("stream", "island").orderBy("here")
    length = F.when(F.col("is_lossy"), F.least(F.sum(lost).over(run.rowsBetween(Window.unboundedPreceding, 0)), F.lit(max_history))).otherwise(0)
    lossy_time = F.when(F.col("is_lossy"), F.col("time"))
    return rows.withColumns({"run": length, "since": F.min(lossy_time).over(run.rowsBetween(1 - max_history, 0))})


def loss_events(df: DataFrame, max_history: int = 30, loss_count: int = 10, consecutive_count: int = 5) -> DataFrame:
    """Both kinds of loss events; a count of 0 switches its kind off."""
    rows = loss_steps(df, max_history)
    latency = (F.unix_millis("time") - F.unix_millis("since")) * 1_000_000
    runs = _event(rows.where((F.col("run") >= consecutive_count) & F.lit(consecutive_count > 0)), "consecutive_loss", F.floor(F.col("run") / max_history), latency, F.concat(F.col("run"), F.lit(" consecutive lost measurements")))
    size = F.least(F.col("here"), F.lit(max_history))
    ratio = _event(rows.where((F.col("lost") > F.col("before")) & (F.col("lost") >= loss_count) & F.lit(loss_count > 0)), "loss_ratio", F.floor(F.col("lost") / max_history), F.lit(0), F.concat(F.col("lost"), F.lit(" of the last "), size, F.lit(" measurements lost")))
    return runs.unionByName(ratio)


def tumbling_metrics(df: DataFrame, width: str = "1 hour", percent: int = 90, accuracy: int = 10_000) -> DataFrame:
    """Of each window: first and last time, mean, upper median, value at ceil((n - 1) * percent / 100), count. Over all streams, as one.

    The two values are exact, and no task holds a window's values: a sketch
    bounds each rank to about 8 / ``accuracy`` of the window, what lies below
    is counted, and only the distinct values between the bounds are put in
    order.
    """
    rows = df.where("value is not null").select(F.window("time", width)["start"].alias("window_start"), "time", "value")
    near = lambda p, way: min(1.0, max(0.0, p + way * 3 / accuracy))
    ends = [near(p, way) for p in (0.5, percent / 100) for way in (-1, 1)]
    per = rows.groupBy("window_start").agg(
        F.min("time").alias("min_time"), F.max("time").alias("max_time"), F.avg("value").alias("mean"),
        F.count("*").alias("n"), F.percentile_approx("value", ends, accuracy).alias("_ends"),
    )
    n = F.col("n")
    ranks = {"median": F.floor(n / 2), f"p{percent}": F.ceil((n - 1) * percent / 100)}
    # in small windows the upper median may lie past the sketch's bound by one rank
    few = n <= accuracy
    for i, (name, rank) in enumerate(ranks.items()):
        per = per.withColumns({
            f"_{name}": rank.cast("long"),
            f"_{name}_low": F.when(few, F.lit(float("-inf"))).otherwise(F.col("_ends")[2 * i]),
            f"_{name}_high": F.when(few, F.lit(float("inf"))).otherwise(F.col("_ends")[2 * i + 1]),
        })
    per = written(per.drop("_ends"), "windows")
    counts = rows.groupBy("window_start", "value").agg(F.count("*").alias("_c")).join(per.drop("mean", "min_time", "max_time"), "window_start")
    out = per
    for name in ranks:
        low, high = F.col(f"_{name}_low"), F.col(f"_{name}_high")
        below = counts.groupBy("window_start").agg(F.sum(F.when(F.col("value") < low, F.col("_c")).otherwise(0)).alias("_below"))
        order = Window.partitionBy("window_start").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        upto = counts.where(F.col("value").between(low, high)).withColumn("_upto", F.sum("_c").over(order))
        found = upto.join(below, "window_start").where(F.col("_below") + F.col("_upto") > F.col(f"_{name}"))
        out = out.join(found.groupBy("window_start").agg(F.min("value").alias(name)), "window_start")
    return out.select("window_start", "min_time", "max_time", "mean", *ranks, "n")


def count_windows(df: DataFrame, size: int, slide: int) -> DataFrame:
    """Sliding count windows, which fire from the first ones on with what is there: here (how many came), n, mean, std (population)."""
    order = Window.partitionBy("stream").orderBy(*ORDER)
    frame = order.rowsBetween(1 - size, 0)
    rows = df.withColumns({"here": F.row_number().over(order), "n": F.count("value").over(frame), "mean": F.avg("value").over(frame), "std": F.stddev_pop("value").over(frame)})
    return rows.where(F.col("here") % slide == 0)


def mode_buckets(df: DataFrame, top: int = 2) -> DataFrame:
    """Each stream's commonest values on two significant digits, rank 1 first; equal counts go to the larger value."""
    v = F.col("value").cast("long")
    size = F.pow(F.lit(10.0), F.greatest(F.char_length(F.abs(v).cast("string")) - 2, F.lit(0))).cast("long")
    rows = df.where("value is not null").groupBy("stream", (F.floor(v / size) * size).cast("long").alias("bucket")).agg(F.count("*").alias("n"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("stream").orderBy(F.desc("n"), F.desc("bucket")))).where(F.col("rank") <= top)


def counts_by(df: DataFrame, column: str) -> DataFrame:
    """How many rows there are of each value of a column, such as the measurements' type."""
    return df.groupBy(column).agg(F.count("*").alias("n"))


def enrich(df: DataFrame, meta: DataFrame, on: str = "stream") -> DataFrame:
    """Measurements with their stream's metadata; those without any are dropped. Catalyst broadcasts metadata that is small enough."""
    return df.join(meta, on, "inner")


def metas_seen(df: DataFrame, meta: DataFrame, on: str = "stream") -> DataFrame:
    """The metadata of the streams that have measurements, once each."""
    return meta.join(df.select(on).distinct(), on, "left_semi").dropDuplicates([on])


def zip_rows(left: DataFrame, right: DataFrame, order_left: list[str], order_right: list[str]) -> DataFrame:
    """The i-th row of left beside the i-th of right; what is left over has no row.

    Positions are global, counted in two passes: rows are range-sorted, each
    partition counts its own, and the small table of partition sizes gives the
    offsets; no task sees all rows.
    """

    def numbered(df: DataFrame, order: list[str]) -> DataFrame:
        rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
        rows = written(rows, "numbered")
        sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
        sizes = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
        return rows.join(sizes, "_part").withColumn("position", F.col("_start") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_start")

    return numbered(left, order_left).join(numbered(right, order_right), "position")


def known_source(df: DataFrame, sources: DataFrame, on: str, documented: bool = False) -> DataFrame:
    """Rows whose ``on`` is not among the sources, as it is known to work; with ``documented`` those that are."""
    return df.join(sources.select(on).distinct(), on, "left_semi" if documented else "left_anti")


def octet_distribution(df: DataFrame, octet: str = "octet") -> DataFrame:
    """Of octets 0 to 255: how many rows have it, and which share has a smaller one."""
    all_octets = df.sparkSession.range(256).select(F.col("id").alias("octet"))
    counts = df.groupBy(F.col(octet).cast("long").alias("octet")).agg(F.count("*").alias("n"))
    rows = all_octets.join(counts, "octet", "left").select("octet", F.coalesce("n", F.lit(0)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("octet").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select("octet", "n", (before / F.greatest(F.sum("n").over(Window.partitionBy()), F.lit(1))).alias("before"))


def nab_format(df: DataFrame, events: DataFrame, binary: bool = False) -> DataFrame:
    """Every measurement with its anomaly score: that of the severest event at its time, on a scale of 1, else 0."""
    scored = events.groupBy("stream", "time").agg(F.max("severity").alias("severity"))
    score = F.when(F.col("severity").isNull(), 0.0).otherwise(F.lit(1.0) if binary else F.col("severity") / 100)
    return df.join(scored, ["stream", "time"], "left").select("stream", F.col("time").alias("timestamp"), "value", score.cast("double").alias("anomaly_score"))
