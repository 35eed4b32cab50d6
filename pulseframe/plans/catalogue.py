"""A query for each operator over the test tables, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.functions import text
from pulseframe.functions.severity import severity_col
from pulseframe.operators import detectors as D
from pulseframe.operators import graph, grouping, runtime, suppress, windows
from pulseframe.plans import tuning
from pulseframe.sources import datatypes

WEEK = 7 * 86400
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def measurements(spark: SparkSession, sf: str, stream: str = "event_type") -> DataFrame:
    """The events as measurements; those of type error count as lost. Their times carry no zone and are taken as UTC."""
    ms = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return runtime.canonical(table(spark, sf, "events"), F.col(stream), F.timestamp_millis(ms), F.col("value"), F.col("event_type") == "error", F.col("event_id"))


def shifted(spark: SparkSession, sf: str) -> DataFrame:
    """A quiet series with a jump every three days, for detectors that the noise of the events never moves."""
    jump = F.floor(F.unix_millis("time") / (3 * 86400 * 1000)) % 2 == 1
    return measurements(spark, sf).withColumn("value", 1000 + F.pmod(F.col("value"), F.lit(7.0)) + F.when(jump, 300_000.0).otherwise(0.0))


def plain(events: DataFrame, *more: str) -> DataFrame:
    return events.select("event_type", "stream", F.col("severity").cast("int"), F.unix_millis("time").alias("time_ms"), *more)


def M(stream: str = "event_type") -> str:
    return f"m AS (SELECT CAST({stream} AS VARCHAR) AS stream, epoch_us(ts) // 1000 AS ms, event_id AS seq, value, event_type = 'error' AS lossy FROM events)"


def SEV(a: str, b: str) -> str:
    low, high = f"least({a}, {b})", f"greatest({a}, {b})"
    base = f"CASE WHEN {low} < 0.1 THEN 4.8 ELSE greatest(1.1, exp(-0.17949 * ln({low}) + 1.13489)) END"
    return f"CASE WHEN {low} = 0 THEN CASE WHEN {high} = 0 THEN 0 ELSE 100 END ELSE CAST(trunc(least(greatest(30.0 * ({high} - {low}) / (({base} - 1) * {low}), 1.0), 100.0)) AS INTEGER) END"


ROWS = "stream, ms AS time_ms, seq, value, lossy AS is_lossy"


def _rows(df: DataFrame) -> DataFrame:
    return df.select("stream", F.unix_millis("time").alias("time_ms"), "seq", "value", "is_lossy")


@query("canonical_measurements", f"WITH {M()} SELECT {ROWS} FROM m")
def canonical_measurements(spark, sf):
    return _rows(measurements(spark, sf))


@query("filter_not_lossy", f"WITH {M()} SELECT {ROWS} FROM m WHERE NOT lossy")
def filter_not_lossy(spark, sf):
    return _rows(runtime.not_lossy(measurements(spark, sf)))


@query("filter_datatype", f"WITH {M()} SELECT {ROWS} FROM m WHERE stream = 'purchase'")
def filter_datatype(spark, sf):
    return _rows(runtime.of_type(measurements(spark, sf).withColumn("datatype", F.col("stream")), "purchase"))


@query("simple_threshold", f"WITH {M()} SELECT 'threshold_events' AS event_type, stream, 10 AS severity, ms AS time_ms FROM m WHERE value > 100")
def simple_threshold(spark, sf):
    return plain(windows.threshold_events(measurements(spark, sf), 100))


@query("severity_pairs", f"WITH {M()}, p AS (SELECT *, lag(value) OVER (PARTITION BY stream ORDER BY ms, seq) AS old FROM m) SELECT seq, {SEV('old', 'value')} AS severity FROM p WHERE old IS NOT NULL")
def severity_pairs(spark, sf):
    from pyspark.sql import Window

    rows = measurements(spark, sf).withColumn("old", F.lag("value").over(Window.partitionBy("stream").orderBy("time", "seq")))
    return rows.where("old is not null").select("seq", severity_col(F.col("old"), F.col("value")).alias("severity"))


BASELINE = f"""WITH {M()},
    r AS (SELECT *, min(value) OVER w AS result, count(*) OVER w AS n FROM m WHERE NOT lossy WINDOW w AS (PARTITION BY stream ORDER BY ms, seq ROWS 49 PRECEDING)),
    p AS (SELECT *, coalesce(lag(result) OVER (PARTITION BY stream ORDER BY ms, seq), 0.0) AS old FROM r),
    s AS (SELECT *, {SEV('old', 'result')} AS severity FROM p WHERE n >= 50)
    SELECT 'baseline_events' AS event_type, stream, severity, ms AS time_ms FROM s WHERE severity > 5"""


@query("baseline_events", BASELINE)
def baseline_events(spark, sf):
    return plain(windows.baseline_events(measurements(spark, sf), threshold=5))


@query("baseline_stepwise", BASELINE)
def baseline_stepwise(spark, sf):
    return plain(runtime.detect(runtime.not_lossy(measurements(spark, sf)), D.Baseline(threshold=5, inactivity=WEEK)))


@query("baseline_percentile", f"""WITH {M()},
    l AS (SELECT *, list_sort(list(value) OVER (PARTITION BY stream ORDER BY ms, seq ROWS 49 PRECEDING)) AS v FROM m WHERE NOT lossy),
    p AS (SELECT *, len(v) AS n, 50 * (len(v) + 1) / 100.0 AS pos FROM l)
    SELECT seq, round(CASE WHEN pos < 1 THEN v[1] WHEN pos >= n THEN v[n] ELSE v[floor(pos)::INT] + (pos - floor(pos)) * (v[floor(pos)::INT + 1] - v[floor(pos)::INT]) END, 6) AS result FROM p""")
def baseline_percentile(spark, sf):
    return windows.baseline_steps(measurements(spark, sf), 50, 50).select("seq", F.round("result", 6).alias("result"))


LOSS = f"""{M('user_id')},
    w AS (SELECT *, lossy::INT AS l, row_number() OVER o AS rn, sum(lossy::INT) OVER (o ROWS 29 PRECEDING) AS cnt, coalesce(sum(lossy::INT) OVER (o ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), 0) AS bef, sum(1 - lossy::INT) OVER (o ROWS UNBOUNDED PRECEDING) AS island FROM m WINDOW o AS (PARTITION BY stream ORDER BY ms, seq)),
    i AS (SELECT *, CASE WHEN lossy THEN least(30, sum(l) OVER (PARTITION BY stream, island ORDER BY rn ROWS UNBOUNDED PRECEDING)) ELSE 0 END AS run, min(CASE WHEN lossy THEN ms END) OVER (PARTITION BY stream, island ORDER BY rn ROWS 29 PRECEDING) AS since FROM w)"""
LOSS_RUNS = f"WITH {LOSS} SELECT 'consecutive_loss' AS event_type, stream, CAST(run // 30 AS INTEGER) AS severity, ms AS time_ms, (ms - since) * 1000000 AS detection_latency FROM i WHERE run >= 2"
LOSS_RATIO = f"WITH {LOSS} SELECT 'loss_ratio' AS event_type, stream, CAST(cnt // 30 AS INTEGER) AS severity, ms AS time_ms, 0::BIGINT AS detection_latency FROM i WHERE cnt > bef AND cnt >= 8"


def _loss(spark, sf):
    return D.Loss(30, 8, 2), measurements(spark, sf, "user_id")


@query("loss_consecutive", LOSS_RUNS)
def loss_consecutive(spark, sf):
    d, m = _loss(spark, sf)
    return plain(runtime.detect(m, d), "detection_latency").where("event_type = 'consecutive_loss'")


@query("loss_ratio", LOSS_RATIO)
def loss_ratio(spark, sf):
    d, m = _loss(spark, sf)
    return plain(runtime.detect(m, d), "detection_latency").where("event_type = 'loss_ratio'")


@query("loss_windows", f"{LOSS_RUNS} UNION ALL {LOSS_RATIO.replace(f'WITH {LOSS} ', '')}")
def loss_windows(spark, sf):
    return plain(windows.loss_events(measurements(spark, sf, "user_id"), 30, 8, 2), "detection_latency")


@query("spike_influence1", f"""WITH {M()},
    r AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY ms, seq) AS rn FROM m WHERE NOT lossy),
    w AS (SELECT *, count(*) OVER o AS n, avg(value) OVER o AS mean, stddev_pop(value) OVER o AS std, lag(value) OVER (PARTITION BY stream ORDER BY rn) AS old FROM r WHERE rn > 1 WINDOW o AS (PARTITION BY stream ORDER BY rn ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))
    SELECT 'spike_events' AS event_type, stream, {SEV('old', 'value')} AS severity, ms AS time_ms FROM w WHERE n >= 30 AND abs(value - mean) > 2.5 * std""")
def spike_influence1(spark, sf):
    return plain(runtime.detect(measurements(spark, sf), D.Spike(30, 2.5, 1.0, WEEK)))


SPIKES = f"""WITH RECURSIVE {M()},
    r AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY ms, seq) AS rn, lag(value) OVER (PARTITION BY stream ORDER BY ms, seq) AS old FROM m WHERE NOT lossy),
    f AS (
        SELECT stream, 1::BIGINT AS rn, CAST([] AS DOUBLE[]) AS h, 0.0::DOUBLE AS mean, 0.0::DOUBLE AS std, false AS hit FROM r WHERE rn = 1
        UNION ALL
        SELECT stream, rn, k, list_avg(k), sqrt(list_avg(list_transform(k, lambda x: (x - list_avg(k)) * (x - list_avg(k))))), hit FROM (
            SELECT r.stream, r.rn, list_append(CASE WHEN len(f.h) >= 30 THEN f.h[2:] ELSE f.h END, CASE WHEN len(f.h) >= 30 AND abs(r.value - f.mean) > 2.5 * f.std THEN 0.01 * r.value + 0.99 * f.h[-1] ELSE r.value END) AS k,
                   len(f.h) >= 30 AND abs(r.value - f.mean) > 2.5 * f.std AS hit
            FROM f JOIN r ON r.stream = f.stream AND r.rn = f.rn + 1))"""


@query("spike_events", f"""{SPIKES}
    SELECT 'spike_events' AS event_type, r.stream, {SEV('r.old', 'r.value')} AS severity, r.ms AS time_ms FROM f JOIN r USING (stream, rn) WHERE f.hit""")
def spike_events(spark, sf):
    return plain(runtime.detect(measurements(spark, sf), D.Spike(30, 2.5, 0.01, WEEK)))


@query("spike_details", f"""{SPIKES},
    d AS (SELECT r.stream, r.ms, r.value, f.mean, 2.5 * f.std AS reach, abs(r.value - f.mean) AS far, len(f.h) AS n FROM r JOIN f ON r.stream = f.stream AND r.rn = f.rn + 1 WHERE len(f.h) > 0)
    SELECT stream, ms AS time_ms, round(value, 9) AS value, round(mean, 9) AS mean, round(CASE WHEN value > mean THEN value - reach ELSE value + reach END, 9) AS bound, round(far + value, 9) AS distance,
           CASE WHEN n < 30 OR far <= reach THEN 0.0 WHEN value > mean THEN 1.0 ELSE -1.0 END::DOUBLE AS signal FROM d""")
def spike_details(spark, sf):
    rows = runtime.details(measurements(spark, sf), D.Spike(30, 2.5, 0.01, WEEK))
    return rows.select("stream", F.unix_millis("time").alias("time_ms"), *(F.round(F.col("detail")[c], 9).alias(c) for c in ("value", "mean", "bound", "distance", "signal")))


@query("measurement_counts", f"WITH {M()} SELECT stream AS datatype, count(*) AS n FROM m GROUP BY ALL")
def measurement_counts(spark, sf):
    return windows.counts_by(measurements(spark, sf).withColumn("datatype", F.col("stream")), "datatype")


def _digits(v: str) -> str:
    return f"CASE WHEN {v} = 0 THEN 0 ELSE length(abs({v})::VARCHAR) END"


# a mode that qualifies is always the last one afterwards, so the last mode is that of the qualifying row before
@query("mode_events", f"""WITH {M()},
    r AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY ms, seq) AS rn, (trunc(value)::BIGINT // pow(10, greatest(length(trunc(value)::BIGINT::VARCHAR) - 2, 0))::BIGINT) * pow(10, greatest(length(trunc(value)::BIGINT::VARCHAR) - 2, 0))::BIGINT AS bucket FROM m WHERE NOT lossy),
    w AS (SELECT stream, rn, ms, list(bucket) OVER (PARTITION BY stream ORDER BY rn ROWS 29 PRECEDING) AS l FROM r WHERE rn > 1),
    c AS (SELECT stream, rn, bucket, count(*) AS n FROM (SELECT stream, rn, unnest(l) AS bucket FROM w WHERE len(l) = 30) GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY stream, rn ORDER BY n DESC, bucket DESC) AS rank FROM c),
    t AS (SELECT stream, rn, max(CASE WHEN rank = 1 THEN bucket END) AS mode, max(CASE WHEN rank = 1 THEN n END) AS n, coalesce(max(CASE WHEN rank = 2 THEN n END), -2) AS second FROM k GROUP BY ALL),
    q AS (SELECT *, lag(mode) OVER (PARTITION BY stream ORDER BY rn) AS old FROM t WHERE n >= 3 AND n - second >= 1),
    e AS (SELECT q.*, w.ms, pow(10, greatest(CASE WHEN {_digits('old')} = {_digits('mode')} THEN {_digits('old')} - 1 ELSE greatest(least({_digits('old')}, {_digits('mode')}), 1) END - 1, 0)) AS div FROM q JOIN w USING (stream, rn)
          WHERE old <> mode AND list_contains(l, old) AND abs(old - mode) >= CASE WHEN old = 1 THEN 1e300 WHEN old = 0 THEN 7.5 ELSE greatest(7.5, old / ln(old)) END),
    s AS (SELECT *, trunc(old / div)::DOUBLE AS a, trunc(mode / div)::DOUBLE AS b FROM e)
    SELECT 'mode_events' AS event_type, stream, {SEV('a', 'b')} AS severity, ms AS time_ms, 'Mode changed from ' || old::VARCHAR || ' to ' || mode::VARCHAR || '!' AS description FROM s""")
def mode_events(spark, sf):
    return plain(runtime.detect(measurements(spark, sf), D.Mode(30, 3, 1, 7.5, WEEK)), "description")


@query("mode_bucket_top2", f"""WITH {M()},
    b AS (SELECT stream, (floor(trunc(value)::BIGINT / pow(10, greatest(length(abs(trunc(value)::BIGINT)::VARCHAR) - 2, 0))) * pow(10, greatest(length(abs(trunc(value)::BIGINT)::VARCHAR) - 2, 0)))::BIGINT AS bucket FROM m),
    c AS (SELECT stream, bucket, count(*) AS n FROM b GROUP BY ALL)
    SELECT stream, bucket, n, row_number() OVER (PARTITION BY stream ORDER BY n DESC, bucket DESC)::INTEGER AS rank FROM c QUALIFY rank <= 2""")
def mode_bucket_top2(spark, sf):
    return windows.mode_buckets(measurements(spark, sf))


# The last 20 values against the 20 before, two dropped at each end. Both sorted lists are walked together until one
# is used up: a value of both is one step, any other a step up or down, and the largest difference is kept with its
# sign. Whether a row lies in an event follows from the last row before it that began or ended one.
DISTDIFF = f"""{M()},
    s AS (SELECT stream, ms, seq, 1000 + value % 7.0::DOUBLE + CASE WHEN ms // 259200000 % 2 = 1 THEN 300000.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM m WHERE NOT lossy AND value IS NOT NULL),
    w AS (SELECT *, list(v) OVER (PARTITION BY stream ORDER BY ms, seq ROWS 39 PRECEDING) AS l, lag(ms, 20) OVER o AS ms20, lag(ms, 39) OVER o AS ms39, lag(ms, 19) OVER o AS ms19 FROM s WINDOW o AS (PARTITION BY stream ORDER BY ms, seq)),
    c AS (SELECT *, list_sort(l[1:20])[3:18] AS o, list_sort(l[21:40])[3:18] AS n FROM w WHERE len(l) = 40),
    x AS (SELECT *, flatten(list_transform(list_sort(list_distinct(o || n)), lambda y: CASE
                 WHEN list_contains(o, y) AND list_contains(n, y) THEN [{{'d': 0.0::DOUBLE, 'm': 0.0::DOUBLE, 'a': len(list_filter(o, lambda q: q = y)), 'b': len(list_filter(n, lambda q: q = y)), 'k': 1::BIGINT}}]
                 WHEN list_contains(o, y) THEN list_transform(list_filter(o, lambda q: q = y), lambda q: {{'d': -0.05::DOUBLE, 'm': 0.0::DOUBLE, 'a': 1::BIGINT, 'b': 0::BIGINT, 'k': 1::BIGINT}})
                 ELSE list_transform(list_filter(n, lambda q: q = y), lambda q: {{'d': 0.05::DOUBLE, 'm': 0.0::DOUBLE, 'a': 0::BIGINT, 'b': 1::BIGINT, 'k': 1::BIGINT}}) END)) AS steps FROM c),
    r AS (SELECT *, list_reduce(list_prepend({{'d': 0.0::DOUBLE, 'm': 0.0::DOUBLE, 'a': 0::BIGINT, 'b': 0::BIGINT, 'k': 0::BIGINT}}, steps), lambda p, q: CASE WHEN p.a >= 16 OR p.b >= 16 THEN p
                 ELSE {{'d': p.d + q.d, 'm': CASE WHEN abs(p.d + q.d) > p.m THEN p.d + q.d ELSE p.m END, 'a': p.a + q.a, 'b': p.b + q.b, 'k': p.k + q.k}} END) AS f FROM x),
    z AS (SELECT *, greatest(abs(f.d + CASE WHEN f.b >= 16 AND f.a < 16 THEN 0.05 ELSE -0.05 END * (32 - f.k)), f.m) * 4 AS z, list_sum(o) AS a, list_sum(n) AS b FROM r),
    g AS (SELECT *, CASE WHEN z < 0.75 THEN 0
                         WHEN z >= 1.5 AND greatest(a, b) / least(a, b) >= 1.05 AND abs(a - b) >= 20 AND NOT (n[16] - n[1] > 0.25 * (o[16] - o[1]) AND abs(a - b) / 16 < 2 * (o[16] - o[1])) THEN 1 END AS signal FROM z),
    e AS (SELECT *, coalesce(last_value(signal IGNORE NULLS) OVER (PARTITION BY stream ORDER BY ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside, a / 16 / 1000 AS mean_old, b / 16 / 1000 AS mean_new FROM g)"""


@query("distdiff_events", f"WITH {DISTDIFF} SELECT 'distdiff_events' AS event_type, stream, {SEV('mean_old', 'mean_new')} AS severity, ms AS time_ms, (ms - ms20) * 1000000 AS detection_latency FROM e WHERE signal = 1 AND inside = 0")
def distdiff_events(spark, sf):
    return plain(runtime.detect(shifted(spark, sf), D.DistDiff(20, 1.05, 1.5, 2, WEEK)), "detection_latency")


@query("distdiff_windowed", f"WITH {DISTDIFF} SELECT 'distdiff_events' AS event_type, stream, {SEV('mean_old', 'mean_new')} AS severity, ms39 AS time_ms, (ms19 - ms39) * 1000000 AS detection_latency FROM e WHERE signal = 1 AND inside = 0")
def distdiff_windowed(spark, sf):
    return plain(runtime.detect(shifted(spark, sf), D.WindowedDistDiff(20, 1.05, 1.5, 2, WEEK)), "detection_latency")


def _longer(runs: str, to: str) -> list[str]:
    """The steps by which runs take one more value v at time ms: each level adds a column, the last is named ``to``."""
    normal = "exp(-((v - q.m) * (v - q.m)) / (2 * q.v)) / sqrt(2 * pi() * q.v)"
    before = "CASE WHEN i = 1 THEN 0 ELSE i END"
    mean = f"(q.m * {before} + v) / ({before} + 1)"
    return [
        f"list_transform({runs}, lambda q, i: {{'m': {mean}, 'v': (q.v * i + (v - {mean}) * (v - q.m)) / (i + 1), 'p': {normal} * q.p, 's': q.s}}) AS {to}1",
        f"list_prepend({{'m': v, 'v': 5e7::DOUBLE, 'p': coalesce(list_sum(list_transform({to}1, lambda q: q.p * 0.005::DOUBLE)), 0.0::DOUBLE), 's': ms}}, list_transform({to}1, lambda q: {{'m': q.m, 'v': q.v, 'p': q.p * 0.995::DOUBLE, 's': q.s}})) AS {to}2",
        f"CASE WHEN len({to}2) > 60 THEN list_append({to}2[1:59], {{'m': {to}2[60].m, 'v': {to}2[60].v, 'p': {to}2[60].p + {to}2[61].p, 's': {to}2[60].s}}) ELSE {to}2 END AS {to}3",
        f"list_sum(list_transform({to}3, lambda q: q.p)) AS {to}t",
        f"list_transform({to}3, lambda q, i: {{'m': q.m, 'v': q.v, 'p': CASE WHEN {to}t > 0 THEN q.p / {to}t WHEN i = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, 's': q.s}}) AS {to}",
    ]


def _changepoint(columns: str) -> str:
    """Runs in order, the newest first; the length of a run is its place less one, and 1 for the first two. f has the state after each row."""
    levels = "f JOIN s ON s.stream = f.stream AND s.rn = f.rn + 1"
    steps = ["f.stream, s.rn, s.ms, s.v, f.runs, least(f.likely, len(f.runs) - 1) AS was, f.odd, f.back, f.event, CASE WHEN f.odd = 0 THEN f.runs ELSE f.normal END AS normal, "
             "CASE WHEN f.odd > 0 THEN f.mean WHEN len(f.runs) = 0 THEN 0.0::DOUBLE ELSE f.runs[CASE WHEN len(f.runs) <= 3 THEN 1 ELSE len(f.runs) - 1 END].m END AS mean, "
             "CASE WHEN f.odd > 0 THEN f.start WHEN len(f.runs) = 0 THEN s.ms ELSE f.runs[least(f.likely, len(f.runs) - 1) + 1].s END AS start"]  # fmt: skip
    steps += [f"*, {x}, {y}" for x, y in zip(_longer("runs", "u"), _longer("normal", "w"), strict=True)]
    first = lambda by: f"CASE WHEN len(u) < 2 THEN 0 ELSE list_position(list_transform(u[1:len(u) - 1], lambda q: {by}), list_max(list_transform(u[1:len(u) - 1], lambda q: {by}))) - 1 END"
    steps.append(f"*, {first('q.p')} AS best, {first('exp(-((v - q.m) * (v - q.m)) / (2 * q.v)) / sqrt(2 * pi() * q.v)')} AS fits")
    steps.append("*, best <> was AS moved, best <> was AND fits = len(u) - 2 AS returns")
    steps.append("*, returns AND back >= 1 AS undone, CASE WHEN moved THEN odd + 1 ELSE 0 END AS odd1, CASE WHEN returns THEN back + 1 ELSE 0 END AS back1")
    steps.append(f"*, NOT undone AND odd1 > 4 AS full_, {SEV('mean', 'v')} AS severity")
    steps.append("*, full_ AND severity > 5 AS over_, full_ AND severity > 5 AND ms - event > 10000 AS hit")
    for x in steps:
        levels = f"(SELECT {x} FROM {levels})"
    none = "CAST([] AS STRUCT(m DOUBLE, v DOUBLE, p DOUBLE, s BIGINT)[])"
    return f"""WITH RECURSIVE {M()},
    s AS (SELECT stream, ms, row_number() OVER (PARTITION BY stream ORDER BY ms, seq) AS rn, 1000 + value % 7.0::DOUBLE + CASE WHEN ms // 259200000 % 2 = 1 THEN 300000.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM m WHERE NOT lossy AND value IS NOT NULL),
    f AS (
        SELECT stream, rn, {none} AS runs, {none} AS normal, 0.0::DOUBLE AS mean, 0::BIGINT AS start, 0::BIGINT AS likely, 0::BIGINT AS odd, 0::BIGINT AS back, 0::BIGINT AS event, false AS hit, 0 AS severity, 0::BIGINT AS began FROM s WHERE rn = 1
        UNION ALL
        SELECT stream, rn, CASE WHEN undone THEN w WHEN over_ THEN {none} ELSE u END, CASE WHEN over_ THEN {none} ELSE normal END, mean, start, CASE WHEN undone THEN was WHEN over_ THEN 0 ELSE best END,
               CASE WHEN undone OR full_ THEN 0 ELSE odd1 END, CASE WHEN undone OR over_ THEN 0 ELSE back1 END, CASE WHEN hit THEN ms ELSE event END, hit, severity, start
        FROM {levels})
    SELECT {columns}"""


@query("changepoint_events", _changepoint("'changepoint_events' AS event_type, stream, severity, ms AS time_ms, (ms - began) * 1000000 AS detection_latency FROM f JOIN s USING (stream, rn) WHERE hit"))
def changepoint_events(spark, sf):
    return plain(runtime.detect(runtime.valued(runtime.not_lossy(shifted(spark, sf))), D.Changepoint(60, 4, 1, WEEK, 10, 5)), "detection_latency")


# what a row meets is the state after the one before
@query("changepoint_details", f"""{_changepoint("s.stream, s.ms AS time_ms, round(s.v, 6) AS value, len(f.runs)::DOUBLE AS runs, f.runs, f.odd::DOUBLE AS odd, list_position(list_transform(f.runs[1:greatest(len(f.runs) - 1, 1)], lambda q: q.p), list_max(list_transform(f.runs[1:greatest(len(f.runs) - 1, 1)], lambda q: q.p))) AS k FROM f JOIN s ON s.stream = f.stream AND s.rn = f.rn + 1 WHERE len(f.runs) > 0").replace("f.runs, f.odd::DOUBLE", "f.runs AS r, f.odd::DOUBLE").replace("    SELECT s.stream", "    SELECT stream, time_ms, value, runs, (k - 1)::DOUBLE AS likeliest, round(r[k].m, 6) AS mean, greatest(k - 1, 1)::DOUBLE AS n, round(r[k].p, 6) AS probability, odd FROM (SELECT s.stream")})""")
def changepoint_details(spark, sf):
    rows = runtime.details(runtime.not_lossy(shifted(spark, sf)), D.Changepoint(60, 4, 1, WEEK, 10, 5))
    return rows.select("stream", F.unix_millis("time").alias("time_ms"), *(F.round(F.col("detail")[c], 6).alias(c) for c in ("value", "runs", "likeliest", "mean", "n", "probability", "odd")))


@query("tumbling_metrics", """WITH g AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS w, epoch_us(min(ts)) // 1000 AS min_ms, epoch_us(max(ts)) // 1000 AS max_ms, avg(value) AS mean, list_sort(list(value)) AS v, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1)
    SELECT epoch_ms(w) AS window_ms, min_ms, max_ms, round(mean, 6) AS mean, v[n // 2 + 1] AS median, v[ceil((n - 1) * 90 / 100.0)::INT + 1] AS p90, n FROM g""")
def tumbling_metrics(spark, sf):
    rows = windows.tumbling_metrics(measurements(spark, sf), "1 day")
    return rows.select(F.unix_millis("window_start").alias("window_ms"), F.unix_millis("min_time").alias("min_ms"), F.unix_millis("max_time").alias("max_ms"), F.round("mean", 6).alias("mean"), "median", "p90", "n")


@query("count_window", f"""WITH {M()},
    w AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY ms, seq) AS here, count(value) OVER o AS n, avg(value) OVER o AS mean, stddev_pop(value) OVER o AS std FROM m WINDOW o AS (PARTITION BY stream ORDER BY ms, seq ROWS 39 PRECEDING))
    SELECT stream, here::INTEGER AS here, n, round(mean, 6) AS mean, round(std, 5) AS std FROM w WHERE here % 5 = 0""")
def count_window(spark, sf):
    return windows.count_windows(measurements(spark, sf), 40, 5).select("stream", "here", "n", F.round("mean", 6).alias("mean"), F.round("std", 5).alias("std"))


@query("enrich_join", "SELECT event_id AS seq, value, c_name, c_nationkey FROM events JOIN customer ON user_id = c_custkey")
def enrich_join(spark, sf):
    meta = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("stream"), "c_name", "c_nationkey")
    return windows.enrich(measurements(spark, sf, "user_id"), meta).select("seq", "value", "c_name", "c_nationkey")


@query("meta_side_output", "SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS stream, c_name FROM customer WHERE c_custkey IN (SELECT user_id FROM events)")
def meta_side_output(spark, sf):
    meta = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("stream"), "c_name")
    return windows.metas_seen(measurements(spark, sf, "user_id"), meta)


@query("zip_positional", """WITH a AS (SELECT event_id AS left_id, row_number() OVER (ORDER BY ts, event_id) AS i FROM events WHERE event_type = 'error'),
    b AS (SELECT event_id AS right_id, row_number() OVER (ORDER BY ts, event_id) AS i FROM events WHERE event_type = 'purchase')
    SELECT left_id, right_id, i - 1 AS position FROM a JOIN b USING (i)""")
def zip_positional(spark, sf):
    m = measurements(spark, sf)
    side = lambda kind, name: m.where(F.col("stream") == kind).select(F.col("time").alias(f"{name}_time"), F.col("seq").alias(f"{name}_id"))
    return windows.zip_rows(side("error", "left"), side("purchase", "right"), ["left_time", "left_id"], ["right_time", "right_id"]).select("left_id", "right_id", F.col("position").cast("long").alias("position"))


@query("known_source_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def known_source_anti(spark, sf):
    return windows.known_source(table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("known_source_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def known_source_semi(spark, sf):
    return windows.known_source(table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", True)


@query("detectors_union", f"SELECT * FROM ({BASELINE}) UNION ALL SELECT * FROM ({ORACLE_SQL['simple_threshold']})")
def detectors_union(spark, sf):
    m = measurements(spark, sf)
    return plain(runtime.union_all([windows.baseline_events(m, threshold=5), windows.threshold_events(m, 100)]))


@query("frequent_filter", f"""WITH RECURSIVE {M()},
    e AS (SELECT stream, ms, row_number() OVER (PARTITION BY stream ORDER BY ms, seq) AS rn, count(*) OVER (PARTITION BY stream ORDER BY ms RANGE BETWEEN 3599999 PRECEDING AND CURRENT ROW) > 3 AS hit FROM m WHERE value > 10),
    f AS (
        SELECT stream, 0::BIGINT AS rn, NULL::BIGINT AS off, 0::BIGINT AS ms, false AS bulk, false AS passed FROM e WHERE rn = 1
        UNION ALL
        SELECT stream, rn, now, ms, bulk, now IS NULL FROM (
            SELECT e.stream, e.rn, e.ms, CASE WHEN e.hit THEN e.ms WHEN f.off < e.ms - 7200000 THEN NULL ELSE f.off END AS now, e.hit AND f.off IS NULL AS bulk
            FROM f JOIN e ON e.stream = f.stream AND e.rn = f.rn + 1))
    SELECT 'threshold_events' AS event_type, stream, 10 AS severity, ms AS time_ms FROM f WHERE passed
    UNION ALL SELECT 'bulk_threshold_events', stream, 25, ms FROM f WHERE bulk""")
def frequent_filter(spark, sf):
    return plain(suppress.suppress(windows.threshold_events(measurements(spark, sf), 10), (suppress.Frequency("own", 3600, 3, 7200, 25),)))


THRESHOLD = f"{M()}, e AS (SELECT stream, ms, seq FROM m WHERE value > 50)"
GAPS = f"""{THRESHOLD}, g AS (SELECT *, CASE WHEN ms - lag(ms) OVER (ORDER BY ms, stream) <= 600000 THEN 0 ELSE 1 END AS new FROM e),
    i AS (SELECT *, sum(new) OVER (ORDER BY ms, stream ROWS UNBOUNDED PRECEDING) AS island FROM g)"""


def _groups(spark, sf, longest):
    return grouping.temporal_groups(windows.threshold_events(measurements(spark, sf), 50), 600, longest)


@query("single_group", f"WITH {THRESHOLD} SELECT ms AS start_ms, ms AS end_ms, stream, 1 AS events FROM e")
def single_group(spark, sf):
    return grouping.single_groups(windows.threshold_events(measurements(spark, sf), 50)).select(F.unix_millis("start_time").alias("start_ms"), F.unix_millis("end_time").alias("end_ms"), F.col("events")[0]["stream"].alias("stream"), F.size("events").alias("events"))


@query("temporal_group_gap", f"WITH {GAPS} SELECT min(ms) AS start_ms, max(ms) AS end_ms, count(*)::INTEGER AS events FROM i GROUP BY island")
def temporal_group_gap(spark, sf):
    return _groups(spark, sf, None).select(F.unix_millis("start_time").alias("start_ms"), F.unix_millis("end_time").alias("end_ms"), F.size("events").alias("events"))


@query("temporal_group_capped", f"""WITH RECURSIVE {GAPS},
    o AS (SELECT *, row_number() OVER (ORDER BY ms, stream) AS rn FROM i),
    f AS (
        SELECT rn, ms, ms AS start, 1::BIGINT AS grp FROM o WHERE rn = 1
        UNION ALL
        SELECT o.rn, o.ms, CASE WHEN o.new = 1 OR o.ms - f.start > 7200000 THEN o.ms ELSE f.start END, f.grp + CASE WHEN o.new = 1 OR o.ms - f.start > 7200000 THEN 1 ELSE 0 END FROM f JOIN o ON o.rn = f.rn + 1)
    SELECT min(ms) AS start_ms, max(ms) AS end_ms, count(*)::INTEGER AS events FROM f GROUP BY grp""")
def temporal_group_capped(spark, sf):
    return _groups(spark, sf, 7200).select(F.unix_millis("start_time").alias("start_ms"), F.unix_millis("end_time").alias("end_ms"), F.size("events").alias("events"))


@query("group_aggregates", f"""WITH {GAPS} SELECT min(ms) AS start_ms, 'threshold_events' AS mode_event_type, count(DISTINCT stream)::INTEGER AS stream_count, count(*)::INTEGER AS event_count, 10 AS mean_severity, 0::BIGINT AS mean_detection_latency, (max(ms) - min(ms)) / 1000.0::DOUBLE AS duration_s FROM i GROUP BY island""")
def group_aggregates(spark, sf):
    return grouping.aggregates(_groups(spark, sf, None)).select(F.unix_millis("start_time").alias("start_ms"), "mode_event_type", "stream_count", "event_count", "mean_severity", "mean_detection_latency", "duration_s")


@query("line_protocol_format", f"""WITH {M()} SELECT 'event_type=threshold_events,stream=' || stream || ' description="x",detection_latency=0i,severity=10i ' || (ms * 1000000)::VARCHAR AS line FROM m WHERE value > 100""")
def line_protocol_format(spark, sf):
    return windows.threshold_events(measurements(spark, sf), 100).withColumn("description", F.lit("x")).select(text.event_line().alias("line"))


@query("line_protocol_roundtrip", "SELECT CAST(event_id AS VARCHAR) AS stream, epoch_us(ts) // 1000 AS time_ms, floor(value)::BIGINT AS median, 0 AS loss, floor(value)::DOUBLE AS value, false AS is_lossy FROM events")
def line_protocol_roundtrip(spark, sf):
    m = measurements(spark, sf)
    v = F.floor("value").cast("string")
    lines = m.select(F.concat(F.lit("data_amp_icmp,stream="), F.col("seq"), F.lit(" loss=0i,lossrate=0.0,median="), v, F.lit('i,packet_size=84i,results=1i,rtts="['), v, F.lit(', None]" '), (F.unix_millis("time") * 1_000_000).cast("string")).alias("value"))
    out = datatypes.of_lines(lines, datatypes.datatype("icmp"))
    return out.select("stream", F.unix_millis("time").alias("time_ms"), "median", F.col("loss").cast("int").alias("loss"), "value", "is_lossy")


@query("event_csv", f"""WITH {M()} SELECT 'threshold_events,' || stream || ',10,' || ms::VARCHAR || ',0:00:00.000,x,""' AS line FROM m WHERE value > 100""")
def event_csv(spark, sf):
    return windows.threshold_events(measurements(spark, sf), 100).withColumn("description", F.lit("x")).select(text.event_csv().alias("line"))


@query("as_path_expand", """WITH p AS (SELECT r_regionkey AS id, '{2.' || r_regionkey::VARCHAR || ',1.-2,3.681}' AS path FROM region)
    SELECT id, i - 1 AS position, CASE WHEN i <= 2 THEN id::INTEGER WHEN i = 3 THEN -2 ELSE 681 END AS as_number, CASE WHEN i = 3 THEN 'private' WHEN i <= 2 AND id = 0 THEN 'unknown' ELSE 'valid' END AS category FROM p, range(1, 7) t(i)""")
def as_path_expand(spark, sf):
    p = table(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.concat(F.lit("{2."), F.col("r_regionkey"), F.lit(",1.-2,3.681}")).alias("path"))
    return p.select("id", F.posexplode(text.as_path(F.col("path"))).alias("position", "as_number")).select("id", F.col("position").cast("long").alias("position"), "as_number", text.as_category(F.col("as_number")).alias("category"))


@query("octet_cdf", """WITH n AS (SELECT o AS octet, (SELECT count(*) FROM events WHERE event_id % 97 = o) AS n FROM range(256) t(o))
    SELECT octet, n, round(coalesce(sum(n) OVER (ORDER BY octet ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / (sum(n) OVER ())::DOUBLE, 9) AS before FROM n""")
def octet_cdf(spark, sf):
    return windows.octet_distribution(table(spark, sf, "events").select((F.col("event_id") % 97).alias("octet"))).select("octet", "n", F.round("before", 9).alias("before"))


def _edges(spark, sf):
    """By the keys as they are; their names are made of the edges, not of the rows."""
    day = F.expr("datediff(cast(l_shipdate as date), date'1970-01-01')")
    rows = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.max(day).alias("day"))
    return rows.select(F.concat(F.lit("S"), "l_suppkey").alias("src"), F.concat(F.lit("P"), "l_partkey").alias("dst"), F.timestamp_seconds(F.col("day").cast("long") * 86400).alias("last_seen"))


EDGES = "x AS (SELECT 'S' || l_suppkey::VARCHAR AS src, 'P' || l_partkey::VARCHAR AS dst, max(epoch_ms(l_shipdate::DATE::TIMESTAMP)) AS last_ms FROM lineitem GROUP BY 1, 2), latest AS (SELECT max(last_ms) AS t FROM x)"


@query("graph_edges", f"WITH {EDGES} SELECT src, dst, last_ms FROM x")
def graph_edges(spark, sf):
    """As a log of changes, folded to the edges' last state."""
    days = F.expr("datediff(cast(l_shipdate as date), date'1970-01-01')")
    rows = table(spark, sf, "lineitem")
    log = rows.select(F.lit("add_or_update_edge").alias("op"), F.concat(F.lit("S"), "l_suppkey").alias("src"), F.concat(F.lit("P"), "l_partkey").alias("dst"), F.timestamp_seconds(days.cast("long") * 86400).alias("time"), F.col("l_orderkey").alias("stream"), F.col("l_linenumber").alias("path_id"), F.lit(0).cast("long").alias("seq"))
    return graph.edges(log).select("src", "dst", F.unix_millis("last_seen").alias("last_ms"))


@query("graph_degree", f"WITH {EDGES} SELECT src, count(*) AS degree FROM x GROUP BY src")
def graph_degree(spark, sf):
    return graph.degrees(_edges(spark, sf))


# the largest component by labels that go from neighbour to neighbour
PRUNED = f"""WITH RECURSIVE {EDGES}, k AS (SELECT src, dst, last_ms FROM x, latest WHERE last_ms >= t - {{age}}),
    b AS (SELECT src AS a, dst AS b FROM k UNION SELECT dst, src FROM k),
    c AS (SELECT a AS origin, a AS node FROM b WHERE a[1] = 'P' UNION SELECT c.origin, b.b FROM c JOIN b ON c.node = b.a),
    l AS (SELECT node, min(origin) AS label FROM c GROUP BY node), n AS (SELECT label, count(*) AS n FROM l GROUP BY label ORDER BY n DESC, label LIMIT 1)
    SELECT src, dst, last_ms FROM k JOIN l ON l.node = k.src JOIN n USING (label)"""
AGE = 21 * 86400


@query("graph_prune_last_seen", PRUNED.format(age=AGE * 1000))
def graph_prune_last_seen(spark, sf):
    edges = _edges(spark, sf)
    now = edges.agg(F.max("last_seen").alias("now"))
    recent = graph.prune_last_seen(edges.crossJoin(F.broadcast(now)), F.col("now"), AGE)
    return recent.select("src", "dst", F.unix_millis("last_seen").alias("last_ms"))


# every component has a supplier, so searching from those finds all
WHOLE = f"""WITH RECURSIVE {EDGES}, b AS (SELECT src AS a, dst AS b FROM x UNION ALL SELECT dst, src FROM x),
    c AS (SELECT DISTINCT src AS origin, src AS node FROM x UNION SELECT c.origin, b.b FROM c JOIN b ON c.node = b.a),
    l AS (SELECT node, min(origin) AS label FROM c GROUP BY node),
    n AS (SELECT label, count(*) AS n, min(node) AS least FROM l GROUP BY label ORDER BY n DESC, least LIMIT 1)
    SELECT src, dst, last_ms FROM x JOIN l ON l.node = x.src JOIN n USING (label)"""


@query("graph_largest_component", WHOLE)
def graph_largest_component(spark, sf):
    return graph.largest_component(_edges(spark, sf)).select("src", "dst", F.unix_millis("last_seen").alias("last_ms"))


# each step goes on from what is reached for the first time, so the search ends when nothing new is
@query("stream_distance", f"""WITH RECURSIVE {EDGES}, b AS (SELECT src AS a, dst AS b FROM x UNION ALL SELECT dst, src FROM x),
    h(origin, node, d) USING KEY (origin, node) AS (
        SELECT DISTINCT src, src, 0 FROM x
        UNION
        SELECT DISTINCT h.origin, b.b, h.d + 1 FROM h JOIN b ON h.node = b.a LEFT JOIN recurring.h AS old ON old.origin = h.origin AND old.node = b.b WHERE old.node IS NULL)
    SELECT origin AS a, node AS b, 2.0::DOUBLE * d AS distance FROM h WHERE node[1] = 'S' AND origin <> node""")
def stream_distance(spark, sf):
    """Of all suppliers by all edges, however far apart."""
    edges = _edges(spark, sf).select("src", "dst")
    metas = edges.select(F.col("src").alias("stream"), F.col("src").alias("source"), F.col("src").alias("destination")).distinct()
    return graph.stream_distances(edges, metas)


@query("param_grid_search", f"""WITH t AS (SELECT * FROM (VALUES (0::BIGINT, 5), (1::BIGINT, 10), (2::BIGINT, 25)) t(param_id, threshold)), e AS ({BASELINE.replace('severity > 5', 'severity > 0')})
    SELECT param_id, event_type, stream, severity, time_ms FROM e, t WHERE severity > threshold""")
def param_grid_search(spark, sf):
    sets = tuning.grid(threshold=[5, 10, 25], inactivityPurgeTime=[WEEK])
    return plain(tuning.evaluate(runtime.not_lossy(measurements(spark, sf)), "baseline", sets), "param_id")


@query("nab_format", f"""WITH {M()}, e AS (SELECT stream, time_ms, max(severity) AS severity FROM ({BASELINE}) GROUP BY ALL)
    SELECT m.stream, m.ms AS time_ms, m.value, CASE WHEN e.severity IS NULL THEN 0.0 ELSE e.severity / 100.0 END::DOUBLE AS anomaly_score FROM m LEFT JOIN e ON m.stream = e.stream AND m.ms = e.time_ms""")
def nab_format(spark, sf):
    m = measurements(spark, sf)
    return windows.nab_format(m, windows.baseline_events(m, threshold=5)).select("stream", F.unix_millis("timestamp").alias("time_ms"), "value", "anomaly_score")
