"""Queries for sources, text formats, topology and suppression: the tables written in a format, read by the library, and the SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.functions import text
from pulseframe.operators import graph, grouping, runtime, suppress, windows
from pulseframe.plans import tuning
from pulseframe.plans.catalogue import GAPS, M, measurements, query, table
from pulseframe.sources import datatypes, files, remote

TEXT = "cast(floor(value) AS bigint)"


def _rows(spark, sf) -> DataFrame:
    """Measurements with v (the value's whole part), s (seconds) and ns, all as text."""
    ms = F.unix_millis("time")
    return measurements(spark, sf).select(
        "seq", "stream", "is_lossy", F.floor("value").cast("string").alias("v"),
        F.floor(ms / 1000).cast("string").alias("s"), (ms * 1_000_000).cast("string").alias("ns"), "value",
    )


def _lines(rows: DataFrame, *parts: Column | str, file: str | Column = "file:/data/a/b.txt") -> DataFrame:
    columns = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return rows.select(F.concat(*columns).alias("value"), (F.lit(file) if isinstance(file, str) else file).alias("file"))


EVENT_ROWS = """m AS (SELECT event_id AS seq, event_type AS stream, event_type = 'error' AS lossy, floor(value)::BIGINT AS v, epoch_us(ts) // 1000 AS ms,
        epoch_us(ts) // 1000000 AS s, value FROM events)"""


@query("latency_amp_files", f"""WITH {EVENT_ROWS}
    SELECT 'src' || seq % 5 || '-dst-' || seq % 7 || '-ipv' || CASE WHEN seq % 2 = 0 THEN '4' ELSE '6' END AS stream, s * 1000 AS time_ms,
           'src' || seq % 5 AS source, 'dst-' || seq % 7 AS destination, CASE WHEN seq % 2 = 0 THEN 'ipv4' ELSE 'ipv6' END AS family,
           v::INTEGER AS average, CASE WHEN lossy THEN 0.5 ELSE 0.0 END::DOUBLE AS lossrate, v::DOUBLE AS value, lossy AS is_lossy FROM m""")
def latency_amp_files(spark, sf):
    r, seq = _rows(spark, sf), F.col("seq")
    family = F.when(seq % 2 == 0, "4").otherwise("6")
    rate = F.when(F.col("is_lossy"), "0.500").otherwise("0.000")
    raw = _lines(r, "src", seq % 5, "-dst-", seq % 7, "-ipv", family, ",", F.col("s"), ",", F.col("v"), ",", rate)
    out = files.latency_icmp(raw)
    return out.select("stream", F.unix_millis("time").alias("time_ms"), "source", "destination", "family", "average", "lossrate", "value", "is_lossy")


@query("latency_smokeping_files", f"""WITH {EVENT_ROWS}
    SELECT CASE WHEN seq % 4 = 0 THEN 'host.v6' ELSE 'host' || seq % 4 END AS stream, s * 1000 AS time_ms, CASE WHEN seq % 4 = 0 THEN 'ipv6' ELSE 'ipv4' END AS family,
           CASE seq % 3 WHEN 0 THEN NULL WHEN 1 THEN v + 1.5 ELSE v + 2.75 END::DOUBLE AS median, CASE seq % 3 WHEN 0 THEN 20 WHEN 1 THEN 17 ELSE 16 END AS loss,
           CASE seq % 3 WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE 4 END AS results FROM m""")
def latency_smokeping_files(spark, sf):
    r, seq, v = _rows(spark, sf), F.col("seq"), F.col("v")
    host = F.when(seq % 4 == 0, "host.v6").otherwise(F.concat(F.lit("host"), seq % 4))
    plus = lambda x: F.concat(F.lit(","), (v.cast("double") + x).cast("string"))
    three = F.concat(plus(4.0), plus(0.0), plus(1.5))
    times = F.when(seq % 3 == 0, "").when(seq % 3 == 1, three).otherwise(F.concat(three, plus(10.0)))
    out = files.latency_smokeping(_lines(r, host, ",", F.col("s"), ",9.9,7.000", times))
    return out.select("stream", F.unix_millis("time").alias("time_ms"), "family", "median", "loss", F.size("results").alias("results"))


@query("nab_files", f"""WITH {EVENT_ROWS} SELECT 'real/' || stream || '.csv' AS stream, s * 1000 AS time_ms, value, false AS is_lossy FROM m""")
def nab_files(spark, sf):
    rows = table(spark, sf, "events")
    file = F.concat(F.lit("file:/data/real/"), "event_type", F.lit(".csv"))
    raw = _lines(rows, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), ",", F.col("value").cast("string"), file=file)
    head = _lines(table(spark, sf, "region"), "timestamp,value", F.substring("r_name", 1, 0), file="file:/data/real/x.csv")
    return files.nab(raw.unionByName(head)).select("stream", F.unix_millis("time").alias("time_ms"), "value", "is_lossy")


def _typed(raw: DataFrame, name: str, *columns: str, family: str = "amp") -> DataFrame:
    out = datatypes.of_lines(raw, datatypes.datatype(name, family))
    return out.select("stream", F.unix_millis("time").alias("time_ms"), *columns, "value", "is_lossy")


@query("lines_http", f"""WITH {EVENT_ROWS} SELECT stream, ms AS time_ms, CASE WHEN NOT lossy THEN v END AS bytes, seq AS duration, CASE WHEN NOT lossy THEN v END::DOUBLE AS value, lossy AS is_lossy FROM m""")
def lines_http(spark, sf):
    size = F.when(F.col("is_lossy"), "").otherwise(F.concat(F.lit("bytes="), "v", F.lit("i,")))
    raw = _lines(_rows(spark, sf), "data_amp_http,stream=", F.col("stream"), " ", size, "duration=", F.col("seq"), "i,object_count=8i,server_count=1i ", F.col("ns"))
    return _typed(raw, "http", "bytes", "duration")


@query("lines_tcpping", f"""WITH {EVENT_ROWS} SELECT stream, ms AS time_ms, v AS median, CASE WHEN lossy THEN 1 ELSE 0 END::BIGINT AS loss, seq % 2 AS icmperrors, [v::INTEGER, NULL]::VARCHAR AS rtts, v::DOUBLE AS value, lossy AS is_lossy FROM m""")
def lines_tcpping(spark, sf):
    loss = F.when(F.col("is_lossy"), "1").otherwise("0")
    raw = _lines(_rows(spark, sf), "data_amp_tcpping,stream=", F.col("stream"), " icmperrors=", F.col("seq") % 2, "i,loss=", loss, "i,lossrate=0.0,median=", F.col("v"), 'i,packet_size=64i,results=1i,rtts="[', F.col("v"), ', None]" ', F.col("ns"))
    out = _typed(raw, "tcpping", "median", "loss", "icmperrors", "rtts")
    return out.withColumn("rtts", F.concat(F.lit("["), F.array_join(F.transform("rtts", lambda x: F.coalesce(x.cast("string"), F.lit("NULL"))), ", "), F.lit("]")))


@query("lines_dns", f"""WITH {EVENT_ROWS} SELECT stream, ms AS time_ms, v AS rtt, seq % 2 = 0 AS flag_aa, CASE WHEN seq % 3 = 0 THEN NULL ELSE 4 END::BIGINT AS opcode, CASE WHEN lossy THEN 1.0 ELSE 0.0 END::DOUBLE AS lossrate, v::DOUBLE AS value, lossy AS is_lossy FROM m""")
def lines_dns(spark, sf):
    flag = F.when(F.col("seq") % 2 == 0, "True").otherwise("f")
    code = F.when(F.col("seq") % 3 == 0, "").otherwise(",opcode=4i")
    rate = F.when(F.col("is_lossy"), "1.0").otherwise("0.0")
    raw = _lines(_rows(spark, sf), "data_amp_dns,stream=", F.col("stream"), " flag_aa=", flag, ",lossrate=", rate, code, ",rtt=", F.col("v"), "i ", F.col("ns"))
    return _typed(raw, "dns", "rtt", "flag_aa", "opcode", "lossrate")


@query("lines_traceroute_pathlen", f"WITH {EVENT_ROWS} SELECT stream, ms AS time_ms, v + 0.5::DOUBLE AS path_length, v + 0.5::DOUBLE AS value, false AS is_lossy FROM m")
def lines_traceroute_pathlen(spark, sf):
    raw = _lines(_rows(spark, sf), "data_amp_traceroute_pathlen,stream=", F.col("stream"), " path_length=", F.col("v"), ".5 ", F.col("ns"))
    broken = _lines(_rows(spark, sf), "data_amp_traceroute_pathlen,stream=x path_length=1.0=2 ", F.col("ns"))
    return _typed(raw.unionByName(broken), "traceroutepathlen", "path_length")


@query("lines_flow_statistics", f"""WITH {EVENT_ROWS} SELECT seq::VARCHAR AS stream, ms AS time_ms, 'ICMP' AS category, v AS in_bytes, 'a b, c=d' AS src_city, NULL::DOUBLE AS dst_latitude, (v + 0.25)::DOUBLE AS ttfb, (v + 0.25)::DOUBLE AS value, false AS is_lossy FROM m""")
def lines_flow_statistics(spark, sf):
    raw = _lines(_rows(spark, sf), "flow_statistics,category=ICMP,type=flow_interval flow_id=", F.col("seq"), "i,in_bytes=", F.col("v"), 'i,src_city="a b, c=d",ttfb=', F.col("v"), ".25 ", F.col("ns"))
    return _typed(raw, "flow", "category", "in_bytes", "src_city", "dst_latitude", "ttfb", family="bigdata")


@query("lines_amp2_latency", f"""WITH {EVENT_ROWS} SELECT 'latency--a--b' || seq % 3 || '--icmp--0--4--84--False' AS stream, ms AS time_ms, 'b' || seq % 3 AS destination, v AS rtt, v::DOUBLE AS value, false AS is_lossy,
        'latency' AS measurement_type, 'icmp' AS test FROM m WHERE seq % 2 = 0""")
def lines_amp2_latency(spark, sf):
    kind = F.when(F.col("seq") % 2 == 0, "icmp").otherwise("dns")
    raw = _lines(_rows(spark, sf), "latency,source=a,destination=b", F.col("seq") % 3, ",test=", kind, ",dscp=0,family=4,packet_size=84,random=False count=1i,rtt=", F.col("v"), "i ", F.col("ns"))
    out = _typed(raw, "latencyicmp", "destination", "rtt", family="amp2")
    tags = text.stream_tags(F.col("stream"))
    return out.withColumns({"measurement_type": tags["measurement_type"], "test": tags["test"]})


@query("lines_amp2_throughput", f"""WITH {EVENT_ROWS} SELECT 'throughput--a--b--tcp--' || CASE WHEN seq % 2 = 0 THEN 'in' ELSE 'out' END || '--0--4--tcp--131072' AS stream, ms AS time_ms,
        CASE WHEN seq % 2 = 0 THEN 'in' ELSE 'out' END AS direction, v AS bytes, seq AS runtime, CASE WHEN seq <> 0 THEN round(v / seq, 9) END::DOUBLE AS bytes_per_runtime, v::DOUBLE AS value, false AS is_lossy FROM m""")
def lines_amp2_throughput(spark, sf):
    way = F.when(F.col("seq") % 2 == 0, "in").otherwise("out")
    raw = _lines(_rows(spark, sf), "throughput,source=a,destination=b,test=tcp,direction=", way, ",dscp=0,family=4,protocol=tcp,write_size=131072 bytes=", F.col("v"), "i,count=1i,runtime=", F.col("seq"), "i ", F.col("ns"))
    out = _typed(raw, "throughput", "direction", "bytes", "runtime", "bytes_per_runtime", family="amp2")
    return out.withColumns({"direction": text.direction(F.upper("direction")), "bytes_per_runtime": F.round("bytes_per_runtime", 9)})


@query("measurement_csv", f"""WITH {EVENT_ROWS} SELECT seq::VARCHAR || ',' || stream || ',' || ms::VARCHAR || ',"1;;3",' || CASE WHEN lossy THEN '' ELSE v::VARCHAR END AS line FROM m""")
def measurement_csv(spark, sf):
    m = measurements(spark, sf)
    kept = F.when(~F.col("is_lossy"), F.floor("value"))
    rows = m.select("seq", "stream", "time", F.array(F.lit(1), F.lit(None).cast("int"), F.lit(3)).alias("rtts"), kept.alias("v"))
    return rows.select(text.csv_line(rows).alias("line"))


# archives over REST


def _documents(spark, sf, kind: str, val: Column) -> DataFrame:
    """A document for each user: a JSON array of their events."""
    rows = table(spark, sf, "events").select("user_id", "event_id", val.alias("val"))
    uri = F.concat(F.lit("/esmond/perfsonar/archive/"), "user_id", F.lit(f"/{kind}/base"))
    docs = rows.groupBy(uri.alias("uri")).agg(F.to_json(F.sort_array(F.collect_list(F.struct(F.col("event_id").alias("ts"), "val")))).alias("value"))
    return docs


URI = "'/esmond/perfsonar/archive/' || user_id || '/{kind}/base'"


@query("esmond_simple", f"""SELECT 'esmond-' || {URI.format(kind='throughput')} AS stream, event_id * 1000 AS time_ms, value, false AS is_lossy, user_id::VARCHAR AS metadata_key, 'throughput' AS event_type, files.kind AS kind
    FROM events, (SELECT 'simple' AS kind) files""")
def esmond_simple(spark, sf):
    out = files.esmond(_documents(spark, sf, "throughput", F.col("value")), files.RESPONSE_KINDS["throughput"])
    return out.select("stream", F.unix_millis("time").alias("time_ms"), "value", "is_lossy", text.metadata_key(F.col("stream")).alias("metadata_key"), text.uri_event_type(F.col("stream")).alias("event_type"), F.col("datatype").alias("kind"))


@query("esmond_histogram", f"""SELECT 'esmond-' || {URI.format(kind='histogram-rtt')} AS stream, event_id * 1000 AS time_ms, unnest([floor(value) + 0.5, 1e6])::DOUBLE AS bucket, unnest([3, event_id % 9])::INTEGER AS n FROM events""")
def esmond_histogram(spark, sf):
    val = F.create_map(F.concat(F.floor("value").cast("string"), F.lit(".5")), F.lit(3), F.lit("1000000"), (F.col("event_id") % 9).cast("int"))
    out = files.esmond(_documents(spark, sf, "histogram-rtt", F.to_json(val)).withColumn("value", F.regexp_replace(F.regexp_replace("value", r'\\"', '"'), r'"(\{[^}]*\})"', "$1")), "histogram")
    return out.select("stream", F.unix_millis("time").alias("time_ms"), F.explode("payload").alias("bucket", "n"))


@query("esmond_failures", f"""SELECT 'esmond-' || {URI.format(kind='failures')} AS stream, event_id * 1000 AS time_ms, 'lost ' || event_type AS payload, NULL::DOUBLE AS value FROM events""")
def esmond_failures(spark, sf):
    val = F.struct(F.concat(F.lit("lost "), "event_type").alias("error"))
    out = files.esmond(_documents(spark, sf, "failures", val), files.RESPONSE_KINDS["failures"])
    return out.select("stream", F.unix_millis("time").alias("time_ms"), "payload", "value")


def _archives(spark, sf) -> DataFrame:
    """A listing: from each nation to its region, throughput with a daily average, and a histogram without summaries."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    rows = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    uri = lambda kind, rest: F.concat(F.lit("/esmond/perfsonar/archive/"), "n_nationkey", F.lit(f"/{kind}/{rest}"))
    average = F.struct(uri("throughput", "averages/86400").alias("uri"), F.lit("average").alias("summary_type"), F.lit("86400").alias("summary_window"))
    updated = F.col("n_nationkey").cast("long") * 3600
    events = F.array(
        F.struct(F.lit("throughput").alias("event_type"), uri("throughput", "base").alias("base_uri"), F.array(average).alias("summaries"), updated.alias("time_updated")),
        F.struct(F.lit("histogram-rtt").alias("event_type"), uri("histogram-rtt", "base").alias("base_uri"), F.slice(F.array(average), 1, 0).alias("summaries"), updated.alias("time_updated")),
    )
    tool = F.when(F.col("n_nationkey") % 2 == 0, "bwctl").otherwise("pscheduler")
    return rows.select(F.col("n_name").alias("source"), F.col("r_name").alias("destination"), F.col("n_name").alias("measurement_agent"), tool.alias("tool_name"), events.alias("event_types"), F.concat(F.lit("/"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")).alias("uri"))


LISTING = """a AS (SELECT n_nationkey AS k, n_name AS source, r_name AS destination, CASE WHEN n_nationkey % 2 = 0 THEN 'bwctl' ELSE 'pscheduler' END AS tool FROM nation JOIN region ON n_regionkey = r_regionkey),
    e AS (SELECT k, tool, source, destination, 'throughput' AS event_type, '/esmond/perfsonar/archive/' || k || '/throughput/base' AS uri, NULL::VARCHAR AS summary_type, NULL::BIGINT AS summary_window FROM a
          UNION ALL SELECT k, tool, source, destination, 'throughput', '/esmond/perfsonar/archive/' || k || '/throughput/averages/86400', 'average', 86400 FROM a
          UNION ALL SELECT k, tool, source, destination, 'histogram-rtt', '/esmond/perfsonar/archive/' || k || '/histogram-rtt/base', NULL, NULL FROM a)"""
FOUND = "source, destination, event_type, uri, summary_type, summary_window"


@query("esmond_discovery", f"WITH {LISTING} SELECT {FOUND} FROM e WHERE tool = 'bwctl'")
def esmond_discovery(spark, sf):
    return remote.discover(_archives(spark, sf), tool="bwctl")


@query("esmond_discovery_summaries", f"WITH {LISTING} SELECT {FOUND} FROM e WHERE event_type = 'throughput' AND summary_type = 'average'")
def esmond_discovery_summaries(spark, sf):
    return remote.discover(_archives(spark, sf), event_types=["throughput"], summary_type="average", summary_window=86400)


@query("esmond_discovery_page", f"WITH {LISTING}, p AS (SELECT k FROM a ORDER BY k LIMIT 7 OFFSET 5) SELECT {FOUND} FROM e WHERE k IN (SELECT k FROM p) AND k * 3600 BETWEEN 21600 AND 36000")
def esmond_discovery_page(spark, sf):
    return remote.discover(_archives(spark, sf), limit=7, offset=5, time_start=21600, time_end=36000)


@query("next_offsets", f"WITH {M('user_id')} SELECT stream, max(ms) // 1000 + 1 AS from_s FROM m GROUP BY stream")
def next_offsets(spark, sf):
    return remote.next_offsets(measurements(spark, sf, "user_id"))


# traceroutes: a route for each order, over a path that its stream has


def _traceroutes(spark, sf) -> DataFrame:
    days = F.expr("datediff(cast(o_orderdate as date), date'1970-01-01')").cast("long") * 86400
    error = F.when(F.col("o_orderkey") % 11 == 0, 3).cast("int")
    hops = F.array((F.col("o_orderkey") % 3).cast("int"), F.lit(7))
    return table(spark, sf, "orders").select((F.col("o_custkey") % 20).cast("long").alias("stream"), (F.col("o_orderkey") % 6).cast("long").alias("path_id"), (F.col("o_orderkey") % 6).cast("long").alias("aspath_id"), days.alias("timestamp"), error.alias("error_type"), F.lit(None).cast("int").alias("error_code"), hops.alias("hop_rtt"), "o_orderkey")


ROUTES = "t AS (SELECT o_custkey % 20 AS stream, o_orderkey % 6 AS path_id, epoch_ms(o_orderdate::DATE::TIMESTAMP) // 1000 AS ts, o_orderkey FROM orders)"


@query("traceroutes_between", f"""WITH {ROUTES} SELECT o_orderkey, stream, ts * 1000 AS time_ms, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 3 END::INTEGER AS first_rtt, o_orderkey % 11 = 0 AS is_lossy
    FROM t WHERE ts > 800000000 AND ts <= 900000000 AND stream IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 2 = 0 INTERSECT SELECT s_suppkey FROM supplier WHERE s_suppkey < 15)""")
def traceroutes_between(spark, sf):
    even = table(spark, sf, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("long").alias("stream"))
    low = table(spark, sf, "supplier").where("s_suppkey < 15").select(F.col("s_suppkey").cast("long").alias("stream"))
    out = remote.traceroutes_between(_traceroutes(spark, sf), 800_000_000, 900_000_000, [even, low])
    return out.select("o_orderkey", "stream", F.unix_millis("time").alias("time_ms"), F.col("hop_rtt")[0].alias("first_rtt"), "is_lossy")


def _parts(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Metadata, paths of five hops (the address depends on place, stream and path; some hops have none) and AS paths."""
    keys = _traceroutes(spark, sf).select("stream", "path_id").distinct()
    hop = lambda i: F.when((F.col("path_id") + i) % 5 == 0, "NULL").otherwise(F.concat(F.lit(f"10.{i}."), F.col("path_id") % 4, F.lit("."), F.col("stream") % 3))
    address = F.concat(F.lit("{"), F.concat_ws(",", *(hop(i) for i in range(5))), F.lit("}"))
    paths = keys.select("stream", "path_id", text.inet_list(address).alias("path"))
    numbers = F.concat(F.lit("{2."), F.col("stream") + 1, F.lit(",1.-2,2.681}"))
    as_paths = keys.where("path_id % 2 = 0").select("stream", F.col("path_id").alias("aspath_id"), text.as_path(numbers).alias("aspath"))
    metas = keys.select("stream", F.concat(F.lit("from"), F.col("stream") % 4).alias("source"), F.concat(F.lit("to"), F.col("stream") % 5).alias("destination")).distinct()
    return metas, paths, as_paths


def _paths(spark, sf, latest: bool = False) -> DataFrame:
    t = _traceroutes(spark, sf).withColumn("time", F.timestamp_seconds("timestamp"))
    return graph.traceroute_paths(t, *_parts(spark, sf), latest=latest)


HOPS = f"""{ROUTES},
    h AS (SELECT stream, path_id, ts, o_orderkey, i, 'from' || stream % 4 AS source, 'to' || stream % 5 AS destination,
                 CASE WHEN (path_id + i) % 5 <> 0 THEN '10.' || i || '.' || path_id % 4 || '.' || stream % 3 END AS address,
                 CASE WHEN path_id % 2 = 1 THEN -1 WHEN i < 2 THEN stream + 1 WHEN i = 2 THEN -2 ELSE 681 END::INTEGER AS as_number FROM t, range(5) r(i)),
    v AS (SELECT *, CASE WHEN i = 0 THEN source WHEN i = 4 THEN destination END AS name,
                 CASE WHEN i = 0 THEN source WHEN i = 4 THEN destination WHEN address IS NOT NULL THEN '(' || address || ',' || as_number || ')' ELSE '(' || stream || ',' || path_id || ',' || i || ')' END AS uid FROM h)"""


@query("traceroute_hops", f"WITH {HOPS} SELECT stream, path_id, ts * 1000 AS time_ms, i AS position, address, as_number, source, destination FROM h")
def traceroute_hops(spark, sf):
    rows = _paths(spark, sf).select("stream", "path_id", F.unix_millis("time").alias("time_ms"), "source", "destination", F.posexplode("hops").alias("position", "hop"))
    return rows.select("stream", "path_id", "time_ms", F.col("position").cast("long").alias("position"), "hop.address", "hop.as_number", "source", "destination")


@query("graph_changes", f"""WITH {HOPS}
    SELECT stream, path_id, ts * 1000 AS time_ms, i AS seq, 'add_vertex' AS op, uid AS src, NULL AS dst FROM v
    UNION ALL SELECT a.stream, a.path_id, a.ts * 1000, 5 + a.i, 'add_or_update_edge', a.uid, b.uid FROM v a JOIN v b ON a.o_orderkey = b.o_orderkey AND b.i = a.i + 1
    UNION ALL SELECT stream, path_id, ts * 1000, 10, 'end', NULL, NULL FROM t""")
def graph_changes(spark, sf):
    return graph.change_events(_paths(spark, sf)).select("stream", "path_id", F.unix_millis("time").alias("time_ms"), "seq", "op", "src", "dst")


@query("graph_vertices", f"""WITH {HOPS}
    SELECT uid, coalesce(string_agg(DISTINCT name, ',' ORDER BY name), '') AS hostnames, count(DISTINCT CASE WHEN address IS NOT NULL THEN address || '/' || as_number END) AS n_addresses, bool_and(name IS NULL AND address IS NULL) AS anonymous FROM v GROUP BY uid""")
def graph_vertices(spark, sf):
    return graph.vertices(_paths(spark, sf, latest=True)).select("uid", F.array_join("hostnames", ",").alias("hostnames"), F.size("addresses").cast("long").alias("n_addresses"), "anonymous")


@query("graph_as_categories", f"""WITH {HOPS}, a AS (SELECT DISTINCT uid, address, as_number FROM v WHERE address IS NOT NULL)
    SELECT CASE as_number WHEN -2 THEN 'private' WHEN -1 THEN 'missing' WHEN 0 THEN 'unknown' ELSE 'valid' END AS category, count(*) AS n FROM a GROUP BY 1""")
def graph_as_categories(spark, sf):
    return graph.category_counts(graph.vertices(_paths(spark, sf, latest=True)))


EDGES = "e AS (SELECT a.uid AS src, b.uid AS dst, max(a.ts) * 1000 AS last_ms FROM v a JOIN v b ON a.o_orderkey = b.o_orderkey AND b.i = a.i + 1 WHERE a.uid <> b.uid GROUP BY ALL)"


@query("graph_path_edges", f"WITH {HOPS}, {EDGES} SELECT src, dst, last_ms FROM e")
def graph_path_edges(spark, sf):
    return graph.edges(graph.change_events(_paths(spark, sf, latest=True))).select("src", "dst", F.unix_millis("last_seen").alias("last_ms"))


# hosts that share an address are one, whatever the AS number that a path gave them
@query("graph_relabel", f"""WITH {HOPS}, {EDGES}, n AS (SELECT address, min(uid) AS canonical FROM v WHERE address IS NOT NULL GROUP BY address HAVING count(DISTINCT uid) > 1),
    k AS (SELECT v.uid, min(n.canonical) AS canonical FROM v JOIN n USING (address) WHERE name IS NULL GROUP BY v.uid)
    SELECT coalesce(a.canonical, src) AS src, coalesce(b.canonical, dst) AS dst, max(last_ms) AS last_ms FROM e LEFT JOIN k a ON a.uid = src LEFT JOIN k b ON b.uid = dst WHERE coalesce(a.canonical, src) <> coalesce(b.canonical, dst) GROUP BY 1, 2""")
def graph_relabel(spark, sf):
    changes = _paths(spark, sf, latest=True)
    hosts = graph.with_hosts(changes).select(F.explode("hosts").alias("h")).select("h.uid", "h.hostname", "h.address").distinct()
    first = hosts.where("address is not null").groupBy("address").agg(F.min("uid").alias("canonical"), F.count_distinct("uid").alias("n")).where("n > 1")
    aliases = hosts.where("hostname is null").join(first, "address").groupBy("uid").agg(F.min("canonical").alias("canonical"))
    return graph.relabel(graph.edges(graph.change_events(changes)), aliases).select("src", "dst", F.unix_millis("last_seen").alias("last_ms"))


@query("alias_resolution", """WITH RECURSIVE p AS (SELECT 'n' || p_partkey AS a, 'n' || (p_partkey // 3) * 3 AS b FROM part WHERE p_partkey % 10 < 8),
    l AS (SELECT a, b FROM p WHERE a <> b UNION SELECT b, a FROM p WHERE a <> b),
    r AS (SELECT a AS origin, a AS node FROM l UNION SELECT r.origin, l.b FROM r JOIN l ON l.a = r.node)
    SELECT node AS uid, min(origin) AS canonical FROM r GROUP BY node""")
def alias_resolution(spark, sf):
    k = F.col("p_partkey")
    pairs = table(spark, sf, "part").where(k % 10 < 8).select(F.concat(F.lit("n"), k).alias("a"), F.concat(F.lit("n"), F.floor(k / 3) * 3).alias("b"))
    return graph.resolve_aliases(pairs)


# router-level files: a node of two addresses for each customer


def _itdk(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    ips = F.concat(F.lit("10."), F.floor(k / 250), F.lit("."), k % 250, F.lit(".1 10."), F.floor(k / 250), F.lit("."), k % 250, F.lit(".2"))
    none = F.lit("# a comment")
    nodes = c.select(F.explode(F.array(F.concat(F.lit("node N"), k, F.lit(":  "), ips), none)).alias("value"))
    numbers = c.where(k % 3 > 0).select(F.concat(F.lit("node.AS N"), k, F.lit(" "), k * 2, F.lit(" refinement")).alias("value"))
    places = c.select(F.concat(F.lit("node.geo N"), k, F.lit(":\tSA\tCO\t\tBogota\t"), k, F.lit(".5\t-74.0")).alias("value"))
    return nodes, numbers, places


NODES = "n AS (SELECT c_custkey AS node_id, '10.' || c_custkey // 250 || '.' || c_custkey % 250 || '.' || j AS ip, j FROM customer, range(1, 3) t(j))"


@query("itdk_node_of_ip", f"WITH {NODES} SELECT ip, CASE WHEN j = 1 THEN node_id END AS node_id, 167772160 + (node_id // 250) * 65536 + node_id % 250 * 256 + j AS number FROM n")
def itdk_node_of_ip(spark, sf):
    nodes = files.itdk_nodes(_itdk(spark, sf)[0])
    out = graph.node_of_ip(nodes.select("ip"), nodes.where("ip like '%.1'"))
    return out.select("ip", "node_id", text.ipv4_number(F.col("ip")).alias("number"))


@query("itdk_node_numbers", "SELECT c_custkey AS node_id, CASE WHEN c_custkey % 3 > 0 THEN c_custkey * 2 ELSE 0 END::INTEGER AS as_number, CASE WHEN c_custkey % 3 > 0 THEN 'refinement' END AS method FROM customer")
def itdk_node_numbers(spark, sf):
    nodes, numbers, _ = _itdk(spark, sf)
    numbers = files.itdk_as(numbers)
    out = graph.node_numbers(files.itdk_nodes(nodes).select("node_id").distinct(), numbers)
    return out.join(numbers.select("node_id", "method"), "node_id", "left").select("node_id", "as_number", "method")


@query("itdk_node_places", "SELECT c_custkey AS node_id, 'SA' AS continent, 'CO' AS country, NULL::VARCHAR AS region, 'Bogota' AS city, (c_custkey + 0.5)::FLOAT AS latitude, (-74.0)::FLOAT AS longitude FROM customer WHERE c_custkey % 2 = 0")
def itdk_node_places(spark, sf):
    nodes, _, places = _itdk(spark, sf)
    wanted = files.itdk_nodes(nodes).where("node_id % 2 = 0").select("node_id").distinct()
    return graph.node_places(wanted, files.itdk_geo(places))


@query("itdk_host_aliases", f"WITH {NODES} SELECT 'h' || ip AS uid, node_id, 'N' || node_id AS canonical, CASE WHEN node_id % 3 > 0 THEN node_id * 2 ELSE 0 END::INTEGER AS as_number FROM n WHERE node_id % 5 = 0")
def itdk_host_aliases(spark, sf):
    nodes, numbers, _ = _itdk(spark, sf)
    nodes = files.itdk_nodes(nodes)
    hosts = nodes.where("node_id % 5 = 0").select(F.concat(F.lit("h"), "ip").alias("uid"), F.col("ip").alias("address"))
    return graph.itdk_aliases(hosts, nodes, files.itdk_as(numbers)).select("uid", "node_id", "canonical", "as_number")


# events, suppression, groups


@query("non_empty_values", "SELECT event_id AS seq, value FROM events WHERE event_id % 3 > 0 AND value IS NOT NULL")
def non_empty_values(spark, sf):
    rows = measurements(spark, sf).withColumn("value", F.when(F.col("seq") % 3 > 0, F.col("value")))
    return runtime.valued(rows).select("seq", "value")


# bursts of 50, some dense and some sparse, so that all three configurations go on and off
BURSTS = "b AS (SELECT event_type AS stream, event_id // 50 * 400000 + event_id % 50 * (event_id // 50 % 7 + 1) * 900 AS ms FROM events WHERE value > 5)"


@query("frequent_filter_defaults", f"""WITH RECURSIVE {BURSTS},
    e AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY ms) AS rn,
                 count(*) OVER (PARTITION BY stream ORDER BY ms RANGE BETWEEN 59999 PRECEDING AND CURRENT ROW) > 5 AS small,
                 count(*) OVER (PARTITION BY stream ORDER BY ms RANGE BETWEEN 119999 PRECEDING AND CURRENT ROW) > 15 AS medium,
                 count(*) OVER (PARTITION BY stream ORDER BY ms RANGE BETWEEN 359999 PRECEDING AND CURRENT ROW) > 100 AS large FROM b),
    f AS (
        SELECT stream, 0::BIGINT AS rn, 0::BIGINT AS ms, NULL::BIGINT AS s, NULL::BIGINT AS m, NULL::BIGINT AS l, false AS bs, false AS bm, false AS bl FROM e WHERE rn = 1
        UNION ALL
        SELECT e.stream, e.rn, e.ms, CASE WHEN small THEN e.ms WHEN s < e.ms - 120000 THEN NULL ELSE s END, CASE WHEN medium THEN e.ms WHEN m < e.ms - 240000 THEN NULL ELSE m END,
               CASE WHEN large THEN e.ms WHEN l < e.ms - 720000 THEN NULL ELSE l END, small AND s IS NULL, medium AND m IS NULL, large AND l IS NULL
        FROM f JOIN e ON e.stream = f.stream AND e.rn = f.rn + 1)
    SELECT 'threshold_events' AS event_type, stream, 10 AS severity, ms AS time_ms FROM f WHERE rn > 0 AND s IS NULL AND m IS NULL AND l IS NULL
    UNION ALL SELECT 'bulk_threshold_events', stream, 25, ms FROM f WHERE bs UNION ALL SELECT 'bulk_threshold_events', stream, 50, ms FROM f WHERE bm
    UNION ALL SELECT 'bulk_threshold_events', stream, 75, ms FROM f WHERE bl""")
def frequent_filter_defaults(spark, sf):
    burst, place = F.floor(F.col("seq") / 50), F.col("seq") % 50
    m = measurements(spark, sf).withColumn("time", F.timestamp_millis(burst * 400_000 + place * (burst % 7 + 1) * 900))
    out = suppress.suppress(windows.threshold_events(m, 5))
    return out.select("event_type", "stream", F.col("severity").cast("int"), F.unix_millis("time").alias("time_ms"))


def _groups(spark, sf) -> DataFrame:
    events = windows.threshold_events(measurements(spark, sf), 50).withColumn("description", F.lit("x"))
    return grouping.with_uid(grouping.temporal_groups(events, 600, None))


# a group is known by its start here, since its uid is a hash of all it holds
@query("events_in_groups", f"WITH {GAPS}, s AS (SELECT *, min(ms) OVER (PARTITION BY island) AS start_ms FROM i) SELECT start_ms, 'threshold_events' AS event_type, stream, ms AS time_ms, true AS tagged FROM s")
def events_in_groups(spark, sf):
    groups = _groups(spark, sf)
    rows = grouping.in_group(groups).withColumn("uid", F.col("tags")["in_group"])
    starts = groups.select("uid", F.unix_millis("start_time").alias("start_ms"))
    return rows.join(starts, "uid").select("start_ms", "event_type", "stream", F.unix_millis("time").alias("time_ms"), (F.length("uid") == 36).alias("tagged"))


@query("group_line_protocol", f"""WITH {GAPS}, q AS (SELECT min(ms) AS a, max(ms) AS b, count(*) AS n, count(DISTINCT stream) AS k FROM i GROUP BY island)
    SELECT 'endTime=' || b * 1000000 || 'i,uid=u meanDetectionLatency=0i,meanSeverity=10i,modeEventType="threshold_events",event_count=' || n || 'i,description="Group of ' || n || ' events over ' || k || ' measurement streams with duration PT'
           || (b - a) // 1000 || 'S, most common event type "threshold_events", mean severity 10, and mean detection latency PT0S" ' || a * 1000000 AS line FROM q""")
def group_line_protocol(spark, sf):
    return grouping.aggregates(_groups(spark, sf)).withColumn("uid", F.lit("u")).select(text.group_line().alias("line"))


@query("tuning_quality", "SELECT event_id % 12 AS param_id, 100 - avg(value) AS quality FROM events GROUP BY 1")
def tuning_quality(spark, sf):
    out = tuning.quality(table(spark, sf, "events").select((F.col("event_id") % 12).alias("param_id"), F.col("value").alias("score")))
    return out.select("param_id", "quality")


# the colours by the circle's sixths, in which one of red, green and blue rises or falls
@query("dot_graph", f"""WITH {HOPS}, {EDGES},
    n AS (SELECT as_number, (0.8::DOUBLE * (row_number() OVER (ORDER BY as_number) - 1) / count(*) OVER () + 0.1::DOUBLE) * 6 AS h FROM (SELECT DISTINCT as_number FROM v WHERE address IS NOT NULL AND as_number > 0)),
    k AS (SELECT as_number, unnest([1, 2, 3]) AS i, h FROM n),
    r AS (SELECT as_number, i, ((h + [0, 4, 2][i]) % 6)::DOUBLE AS x FROM k),
    y AS (SELECT as_number, '#' || string_agg(upper(lpad(hex(floor((0.95::DOUBLE * (1 - 0.5::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, least(x, 6 - x) - 1)))) * 255 + 0.5::DOUBLE)::BIGINT), 2, '0')), '' ORDER BY i) AS colour FROM r GROUP BY as_number),
    w AS (SELECT uid, max(name) AS name, min(CASE WHEN address IS NOT NULL AND as_number > 0 THEN as_number END) AS as_number FROM v GROUP BY uid)
    SELECT 0 AS part, '' AS key, 'strict digraph G {{' AS line UNION ALL SELECT 3, '', '}}'
    UNION ALL SELECT 1, uid, '  "' || uid || '" [style=filled, shape=oval, fillcolor="' || CASE WHEN name IS NOT NULL THEN '#FF0000' ELSE coalesce(colour, '#FFFFFF') END || '"];' FROM w LEFT JOIN y USING (as_number)
    UNION ALL SELECT 2, src || '|' || dst, '  "' || src || '" -> "' || dst || '";' FROM e""")
def dot_graph(spark, sf):
    paths = _paths(spark, sf, latest=True)
    return graph.dot_lines(graph.vertices(paths), graph.edges(graph.change_events(paths)))


# all steps in a row; which anonymous hosts are parallel is not for SQL, a test has the steps one by one
@query("graph_topology")
def graph_topology(spark, sf):
    t = _traceroutes(spark, sf).withColumn("time", F.timestamp_seconds("timestamp"))
    _, links = graph.topology(t, *_parts(spark, sf), age_s=400 * 86400)
    return links.select("src", "dst", F.unix_millis("last_seen").alias("last_ms"))
