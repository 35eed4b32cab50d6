"""Operators over batches against the steps, brute force and small fixtures."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pulseframe import config
from pulseframe.functions import text
from pulseframe.operators import detectors as D
from pulseframe.operators import graph, grouping, runtime, suppress, windows
from pulseframe.operators.components import components
from pulseframe.plans import catalogue, tuning
from pulseframe.schemas import EVENT

START = datetime(2024, 1, 1)


def events(spark, seconds, stream="s", kind="k"):
    rows = [(kind, stream, 10, START + timedelta(seconds=s), 0, "d", {}) for s in seconds]
    return spark.createDataFrame(rows, EVENT)


def spans(groups):
    return sorted(((r.start_time - START).total_seconds(), (r.end_time - START).total_seconds(), len(r.events)) for r in groups.collect())


def test_suppression_by_rate(spark):
    out = [r.event_type for r in suppress.suppress(events(spark, range(0, 90, 4))).collect()]
    assert (out.count("k"), out.count("bulk_k")) == (5, 2)
    out = suppress.suppress(events(spark, range(0, 240, 5))).collect()
    assert [r.event_type for r in out].count("bulk_k") == 2


def test_groups_merge_part_at_gaps_and_at_the_longest_duration(spark):
    assert spans(grouping.temporal_groups(events(spark, [5.0, 5.1, 25, 99995]), 10, 7200)) == [(5.0, 5.1, 2), (25, 25, 1), (99995, 99995, 1)]
    run = spans(grouping.temporal_groups(events(spark, range(0, 7301, 5)), 10, 7200))
    assert run == [(0, 7200, 1441), (7205, 7300, 20)]
    assert spans(grouping.single_groups(events(spark, [1, 2]))) == [(1, 1, 1), (2, 2, 1)]
    assert grouping.temporal_groups(events(spark, []), 10, 7200).count() == 0


def test_keyed_and_single_sequence_gaps_agree(spark):
    seconds = [0, 3, 8, 30, 31, 5000, 5001, 40000, 40010, 40021, 10**6]
    one = spans(grouping.temporal_groups(events(spark, seconds), 10, None))
    keyed = spans(grouping.temporal_groups(events(spark, seconds), 10, None, ("stream",)))
    assert one == keyed == [(0, 8, 3), (30, 31, 2), (5000, 5001, 2), (40000, 40010, 2), (40021, 40021, 1), (10**6, 10**6, 1)]


def test_group_uids_and_aggregates(spark):
    e = events(spark, [0, 1], "a").unionByName(events(spark, [2], "b", "z"))
    groups = grouping.with_uid(grouping.temporal_groups(e, 10, 7200))
    (r,) = grouping.aggregates(groups).collect()
    assert (r.mode_event_type, r.stream_count, r.event_count, r.mean_severity, r.duration_s) == ("k", 2, 3, 10, 2.0)
    assert {t["in_group"] for (t,) in grouping.in_group(groups).select("tags").collect()} == {r.uid}
    (line,) = grouping.aggregates(groups).select(text.group_line()).first()
    assert line.startswith("endTime=") and "event_count=3i" in line


def test_events_as_lines_and_csv(spark):
    e = spark.createDataFrame([("threshold_events", "1", 10, datetime.fromtimestamp(1564713045), 123456789, "A test event :)", {"type": "test", "secondTag": "alsoTest"}), ("e", "latency--a--b--icmp--x", 1, datetime.fromtimestamp(1), 0, "d", {})], EVENT)
    one, two = (r[0] for r in e.select(text.event_line()).collect())
    assert one == 'event_type=threshold_events,secondTag=alsoTest,stream=1,type=test description="A test event :)",detection_latency=123456789i,severity=10i 1564713045000000000'
    assert "destination=b" in two and "measurement_type=latency" in two
    assert e.select(text.event_csv()).first()[0].split(",")[4] == "0:00:00.123"


def test_line_protocol_splits_outside_quotes(spark):
    lines = ['m,a=1,b=x f="p, q=r",g=2i 1500000', "m,a=1,b f=1 1", "m f=1", 'm f="x y" 9999999', None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in lines], "v string").select(text.line_protocol(F.col("v"))).collect()]
    assert (got[0].name, got[0].tags, got[0].fields, got[0].time_ms) == ("m", {"a": "1", "b": "x"}, {"f": '"p, q=r"', "g": "2i"}, 1)
    assert got[1:3] == [None, None] and got[3].fields == {"f": '"x y"'} and got[4] is None


def test_scalar_parsers(spark):
    row = spark.range(1).select(text.rtt_list(F.lit('"[1, None]"')).alias("a"), text.as_path(F.lit("{2.681,1.-2}")).alias("b"), text.inet_list(F.lit("{1.2.3.4,NULL}")).alias("c"), text.direction(F.lit("IN")).alias("d"), text.ipv4_number(F.lit("1.0.0.255")).alias("e"), text.zip_hops(F.array(F.lit("x"), F.lit("y")), F.array(F.lit(7))).alias("f"), text.zip_hops(F.array(F.lit("x")), None).alias("g")).first()
    assert (row.a, row.b, row.c, row.d, row.e) == ([1, None], [681, 681, -2], ["1.2.3.4", None], "in", 16777471)
    assert row.f == [("x", 7)] and row.g == [("x", -1)]
    with pytest.raises(Exception, match="no direction"):
        spark.range(1).select(text.direction(F.lit("up"))).collect()


def test_windows_agree_with_steps(spark):
    rows = [(s, START + timedelta(seconds=i), i, float((i * 7919) % 251), (i * 31) % 5 < 2) for s in "ab" for i in range(200)]
    m = spark.createDataFrame(rows, "stream string, time timestamp, seq long, value double, is_lossy boolean")
    key = lambda df: sorted((r.event_type, r.stream, r.time, r.severity, r.detection_latency) for r in df.collect())
    assert key(windows.loss_events(m, 30, 8, 2)) == key(runtime.detect(m, D.Loss(30, 8, 2)))
    clean = runtime.not_lossy(m)
    for percent in (0.1, 50):
        assert key(windows.baseline_events(clean, 20, percent, 5)) == key(runtime.detect(clean, D.Baseline(20, percent, 5, 10**6)))
    assert runtime.detect(m.where("false"), D.Loss()).count() == 0


def test_parameter_sets_in_one_job(spark):
    rows = [("a", START + timedelta(seconds=i), i, float((i * 7919) % 251), False) for i in range(200)]
    m = spark.createDataFrame(rows, "stream string, time timestamp, seq long, value double, is_lossy boolean")
    sets = tuning.grid(threshold=[1, 20], maxHistory=[10])
    got = tuning.evaluate(m, "baseline", sets).groupBy("param_id").count().collect()
    for i, n in got:
        assert n == runtime.detect(m, config.build_detector("baseline", overrides=sets[i])).count()
    assert all(config.validate({f"detector.mode.{k}": v for k, v in p.items()}) for p in tuning.random_search("mode", 5))


def test_zip_leaves_no_gaps(spark):
    left, right = spark.range(25).withColumnRenamed("id", "a"), spark.range(100, 110).withColumnRenamed("id", "b")
    assert sorted((r.a, r.b) for r in windows.zip_rows(left, right, ["a"], ["b"]).collect()) == [(i, 100 + i) for i in range(10)]


def test_settings(spark):
    assert config.merge({"a": [{"x": 1}, {"y": 2}]}, {"a": {"x": 3}}) == {"a": {"x": 3, "y": 2}}
    assert config.unflatten(config.flatten({"a": {"b": 1, "c": {"d": 2}}})) == {"a": {"b": 1, "c": {"d": 2}}}
    assert config.build_detector("spike").lag == 50
    with pytest.raises(ValueError, match="out of"):
        config.build_detector("baseline", overrides={"threshold": 101})
    with pytest.raises(ValueError, match="doesn't hold"):
        config.build_detector("changepoint", overrides={"triggerCount": 60})
    assert config.build_detector("changepoint", overrides={"inactivityPurgeTime": 0}).inactivity == 0
    assert "{ detector_mode_minFrequency >= detector_mode_maxHistory }" in config.tuner_text(["mode"])


def edge_rows(spark, pairs):
    return spark.createDataFrame([(a, b, START) for a, b in pairs], "src string, dst string, last_seen timestamp")


def test_components_of_chains_and_rings(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(pairs, "u long, v long")).collect())
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_parallel_anonymous_chains_become_one(spark):
    pairs = [p for c in range(5) for p in zip(["top", *(f"({c},0,{i})" for i in range(4))], [*(f"({c},0,{i})" for i in range(4)), "bottom"], strict=True)]
    hidden = spark.createDataFrame([(f"({c},0,{i})",) for c in range(5) for i in range(4)], "uid string")
    edges = edge_rows(spark, pairs)
    aliases = graph.parallel_anonymous(edges, hidden)
    after = graph.relabel(edges, aliases)
    assert sorted((r.src, r.dst) for r in after.collect()) == sorted([("top", "(0,0,0)"), ("(0,0,0)", "(0,0,1)"), ("(0,0,1)", "(0,0,2)"), ("(0,0,2)", "(0,0,3)"), ("(0,0,3)", "bottom")])


def test_pruning_keeps_what_was_seen(spark):
    rows = [(f"h{i:02}", f"h{i + 1:02}", START - timedelta(hours=i)) for i in range(24)]
    kept = graph.prune_last_seen(spark.createDataFrame(rows, "src string, dst string, last_seen timestamp"), F.lit(START), 12 * 3600)
    assert {r.src for r in kept.collect()} == {f"h{i:02}" for i in range(13)}


def lineitem(spark, folder, rows):
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_shipdate date").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_the_largest_component_is_of_edges_of_any_age(spark, tmp_path):
    day = lambda n: START.date() - timedelta(days=n)
    rows = [(s, p, day(40 * s + p)) for s in range(4) for p in (s, s + 1)] + [(8, 20, day(0)), (8, 21, day(1)), (9, 21, day(2))]
    got = catalogue.QUERIES["graph_largest_component"](spark, lineitem(spark, tmp_path, rows)).collect()
    assert sorted((r.src, r.dst) for r in got) == sorted((f"S{s}", f"P{p}") for s in range(4) for p in (s, s + 1))


def test_distances_by_edges_of_any_age_and_any_number_of_hops(spark, tmp_path):
    rows = [(s, p, START.date() - timedelta(days=40 * s)) for s in range(5) for p in (s, s + 1)] + [(8, 20, START.date()), (9, 20, START.date())]
    got = {(r.a, r.b): r.distance for r in catalogue.QUERIES["stream_distance"](spark, lineitem(spark, tmp_path, rows)).collect()}
    want = {(f"S{a}", f"S{b}"): 4.0 * abs(a - b) for a in range(5) for b in range(5) if a != b}
    assert got == want | {("S8", "S9"): 4.0, ("S9", "S8"): 4.0}


def test_traceroutes_to_graph(spark):
    t = spark.createDataFrame([(18, 40, 1, START), (19, 41, None, START)], "stream int, path_id int, aspath_id int, time timestamp")
    metas = spark.createDataFrame([(18, "amp-a", "z"), (19, "amp-b", "z")], "stream int, source string, destination string")
    paths = spark.createDataFrame([(18, 40, ["1.1.1.1", None, "9.9.9.9"]), (19, 41, ["2.2.2.2", "3.3.3.3", "9.9.9.9"])], "stream int, path_id int, path array<string>")
    numbers = spark.createDataFrame([(18, 1, [5, 5, 6])], "stream int, aspath_id int, aspath array<int>")
    found = graph.traceroute_paths(t, metas, paths, numbers)
    changes = graph.change_events(found)
    assert sorted((r.src, r.dst) for r in graph.edges(changes).collect()) == [("(18,40,1)", "z"), ("(3.3.3.3,-1)", "z"), ("amp-a", "(18,40,1)"), ("amp-b", "(3.3.3.3,-1)")]
    v = {r.uid: r for r in graph.vertices(found).collect()}
    assert v["(18,40,1)"].anonymous and not v["z"].anonymous and len(v["z"].addresses) == 2
    d = {(r.a, r.b): r.distance for r in graph.stream_distances(graph.edges(changes), metas).collect()}
    assert d == {(18, 19): 8.0, (19, 18): 8.0}
    lines = graph.dot_lines(graph.vertices(found), graph.edges(changes)).orderBy("part", "key").collect()
    assert lines[0].line.startswith("strict digraph") and lines[-1].line == "}" and any("shape=box" in r.line for r in lines)


def test_distances_of_a_long_chain(spark):
    edges = edge_rows(spark, [(f"h{i:02}", f"h{i + 1:02}") for i in range(36)])
    metas = spark.createDataFrame([(1, "h00", "h01"), (2, "h36", "h35")], "stream int, source string, destination string")
    got = lambda **x: {(r.a, r.b): r.distance for r in graph.stream_distances(edges, metas, **x).collect()}
    assert got() == {(1, 2): 72.0, (2, 1): 72.0} and got(most=32) == {}
    assert got(documented=True) == {(1, 2): 70.0, (2, 1): 70.0}


def test_aliases_and_nodes(spark):
    pairs = spark.createDataFrame([("b", "a"), ("c", "b")], "a string, b string")
    assert dict(graph.resolve_aliases(pairs).collect()) == {"a": "a", "b": "a", "c": "a"}
    nodes = spark.createDataFrame([(1, "1.1.1.1"), (2, "2.2.2.2")], "node_id long, ip string")
    numbers = spark.createDataFrame([(1, 11814)], "node_id long, as_number int")
    hosts = spark.createDataFrame([("x", "1.1.1.1"), ("y", "2.2.2.2")], "uid string, address string")
    assert sorted((r.uid, r.canonical, r.as_number) for r in graph.itdk_aliases(hosts, nodes, numbers).collect()) == [("x", "N1", 11814), ("y", "N2", 0)]
    both = spark.createDataFrame([("x", "1.1.1.1"), ("x", "2.2.2.2")], "uid string, address string")
    with pytest.raises(Exception, match="two nodes"):
        graph.itdk_aliases(both, nodes).collect()


def test_a_hub_is_split_in_the_joins_of_components(spark):
    """What components() joins: neighbours with what they were aggregated to. Most edges meet in one node."""
    from pulseframe.operators.components import _nearest, components

    hot = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in hot}
    try:
        for k, v in hot.items():
            spark.conf.set(k, v)
        ids = spark.range(60_000).repartition(8)
        edges = ids.select(F.when(F.col("id") % 5 == 0, F.col("id")).otherwise(F.lit(70_000)).alias("u"), (F.xxhash64("id") % 10**12 + 2 * 10**12).alias("v"))
        joined = edges.join(_nearest(edges), "u")
        most = max(joined.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect())
        plan = joined._jdf.queryExecution()
        plan.executedPlan().execute().count()
        assert "skew=true" in plan.executedPlan().toString()
        assert most < 48_000
        sizes = components(edges).groupBy("component").count().collect()
        assert max(r[1] for r in sizes) == 48_001 and len(sizes) == 12_001
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_components_of_a_long_chain_and_of_odd_edges(spark):
    from pulseframe.operators.components import components

    rows = [(i, i + 1) for i in range(300)] + [(5, 5), (None, 3), (900, 901), (901, 900)]
    got = {r.node: r.component for r in components(spark.createDataFrame(rows, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(301)} | {900: 900, 901: 900}
    assert components(spark.createDataFrame([], "u string, v string")).count() == 0


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from pulseframe.operators import scratch

    class Session:
        class sparkContext:
            master = "spark://somewhere:7077"

            class _jsc:
                @staticmethod
                def sc():
                    return type("c", (), {"getCheckpointDir": lambda self: type("o", (), {"isDefined": lambda self: False})()})()

        class conf:
            get = staticmethod(lambda name, other: other)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.checkpoint_folder(Session)


def test_the_topology_is_its_steps_one_by_one(spark):
    """Traceroutes over five parallel paths of anonymous hosts, one that is too old, and two addresses of one router."""
    minute = lambda m: START + timedelta(minutes=m)
    traces = [(1, k, 0, minute(100)) for k in range(5)] + [(2, 9, 0, minute(101)), (3, 7, 0, minute(0))]
    t = spark.createDataFrame(traces, "stream long, path_id long, aspath_id long, time timestamp")
    metas = spark.createDataFrame([(1, "top", "bottom"), (2, "top", "bottom"), (3, "old", "gone")], "stream long, source string, destination string")
    paths = [(1, k, ["1.1.1.1", "2.2.2.2" if k % 2 else "2.2.2.3", None, None, "3.3.3.3", "9.9.9.9"]) for k in range(5)]
    paths += [(2, 9, ["1.1.1.1", "4.4.4.4", "9.9.9.9"]), (3, 7, ["7.7.7.7", "8.8.8.8"])]
    paths = spark.createDataFrame(paths, "stream long, path_id long, path array<string>")
    as_paths = spark.createDataFrame([], "stream long, aspath_id long, aspath array<int>")
    nodes = spark.createDataFrame([(5, "2.2.2.2"), (5, "2.2.2.3")], "node_id long, ip string")
    vertices, links = graph.topology(t, metas, paths, as_paths, nodes, 3600)
    got = {(r.src, r.dst) for r in links.collect()}
    hidden = sorted({x for e in got for x in e if x.startswith("(1,")})
    assert len(hidden) == 2  # five chains of two anonymous hosts are one
    a, b = hidden
    assert got == {("top", "N5"), ("N5", a), (a, b), (b, "(3.3.3.3,-1)"), ("(3.3.3.3,-1)", "bottom"), ("top", "(4.4.4.4,-1)"), ("(4.4.4.4,-1)", "bottom")}
    assert {r.uid for r in vertices.collect()} == {x for e in got for x in e}
    lines = [r.line for r in graph.dot_lines(vertices, links).collect()]
    assert sum('fillcolor="#FF0000"' in x for x in lines) == 2 and sum("->" in x for x in lines) == 7


def test_percentile_sorts_once(spark):
    """The window's values are sorted natively and once a row, not again for each place that names them."""
    df = spark.createDataFrame([("a", i, i, float(i * 7 % 11)) for i in range(30)], "stream string, t long, seq long, value double")
    rows = windows.baseline_steps(df.select("stream", F.timestamp_seconds("t").alias("time"), "seq", "value", F.lit(False).alias("is_lossy")), 5, 50)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array(") == 1 and "array_sort(" not in plan
    values = [float(i * 7 % 11) for i in range(30)]
    for r in rows.collect():
        assert r.result == D.percentile(values[max(0, r.seq - 4) : r.seq + 1], 50)


def test_latest_paths_give_the_same_graph(spark):
    """A path that comes a thousand times is one row, and vertices and edges are as with all of them."""
    rows = spark.range(1000).select((F.col("id") % 2).alias("stream"), (F.col("id") % 3).alias("path_id"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("aspath_id"), F.timestamp_seconds("id").alias("time"))
    metas = spark.createDataFrame([(0, "a", "z"), (1, "b", "z")], "stream long, source string, destination string")
    paths = spark.createDataFrame([(s, p, ["1", None if p else "2", "3"]) for s in range(2) for p in range(3)], "stream long, path_id long, path array<string>")
    numbers = spark.createDataFrame([(s, 1, [7, 7, 7]) for s in range(2)], "stream long, aspath_id long, aspath array<int>")
    every, last = (graph.traceroute_paths(rows, metas, paths, numbers, latest=x) for x in (False, True))
    assert every.count() == 1000 and last.count() == 6
    for f in (graph.vertices, lambda x: graph.edges(graph.change_events(x))):
        assert sorted(map(str, f(every).collect())) == sorted(map(str, f(last).collect()))


def test_end_distances_by_bits(spark, monkeypatch):
    """Over several components, with more ends than a row has bits, as one join a hop finds them."""
    monkeypatch.setattr(graph, "_WORDS", 1)
    links = [(f"s{i}", f"p{i % 3}") for i in range(150)] + [("s0", "p1"), ("s1", "p2"), ("x1", "y"), ("x2", "y"), ("y", "y")]
    edges = spark.createDataFrame(links, "src string, dst string")
    ends = spark.createDataFrame([(f"s{i}",) for i in range(0, 150, 2)] + [("x1",), ("x2",), ("alone",), ("p3",)], "uid string")
    for most in (None, 3):
        slow = graph.hop_distances(edges, ends, most).join(ends.withColumnRenamed("uid", "node"), "node", "left_semi").select("origin", "node", "hops")
        got = graph.end_distances(edges, ends, most)
        assert sorted(got.collect()) == sorted(slow.collect())
    assert got.where("origin = 'alone'").collect()[0][:] == ("alone", "alone", 0)


def test_components_of_dense_graphs_by_a_sample_keep_links_that_it_leaves_out(spark, monkeypatch):
    """The one edge between two of three cliques is to no node's smallest or largest neighbour."""
    from pulseframe.operators import components as module

    monkeypatch.setattr(module, "MANY", 1)
    cliques = [range(0, 48, 2), range(1, 48, 2), range(100, 124)]
    rows = [(a, b) for c in cliques for a in c for b in c if a < b] + [(10, 25)]
    calls, known = [], module._by_sample
    monkeypatch.setattr(module, "_by_sample", lambda *a: calls.append(1) or known(*a))
    got = module.components(spark.createDataFrame(rows, "u long, v long"))
    assert calls == [1]
    assert sorted(map(tuple, got.collect())) == [(n, 0) for n in range(48)] + [(n, 100) for n in range(100, 124)]
