"""File and remote sources, batch and streaming, and flows over them."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pulseframe.functions import text
from pulseframe.operators import runtime
from pulseframe.operators.detectors import Baseline
from pulseframe.plans import dag
from pulseframe.sources import datatypes, files, remote, sinks


def of(spark, *lines):
    return spark.createDataFrame([(x, f"file:/data/realKnown/f.csv") for x in lines], "value string, file string")


def typed(spark, kind, line, family="amp"):
    return datatypes.of_lines(of(spark, line), datatypes.datatype(kind, family)).first()


def test_line_measurements(spark):
    r = typed(spark, "icmp", 'data_amp_icmp,stream=3 loss=0i,lossrate=0.0,median=225i,packet_size=520i,results=1i,rtts="[225]" 1563761840000000000')
    assert (r.stream, r.loss, r.median, r.rtts, r.value, r.is_lossy, r.time) == ("3", 0, 225, [225], 225.0, False, datetime(2019, 7, 22, 2, 17, 20))
    r = typed(spark, "icmp", 'data_amp_icmp,stream=3 loss=1i,lossrate=1.0,packet_size=520i,results=1i,rtts="[None]" 1574696840000000000')
    assert r.median is None and r.rtts == [None] and r.is_lossy
    r = typed(spark, "dns", "data_amp_dns,stream=1 lossrate=1.0,requests=1i 1573020910000000000")
    assert r.is_lossy and r.rtt is None and r.requests == 1 and r.flag_aa is None
    r = typed(spark, "traceroutepathlen", "data_amp_traceroute_pathlen,stream=5 path_length=12.0 1563761842000000000")
    assert r.value == 12.0 and not r.is_lossy
    assert typed(spark, "http", "data_amp_http,stream=17 duration=77i,object_count=8i,server_count=1i 1564713045000000000").is_lossy
    r = typed(spark, "latencyicmp", "latency,source=a,destination=b,test=icmp,dscp=0,family=4,packet_size=84,random=False count=1i,rtt=9i 1000000000", "amp2")
    assert r.stream == "latency--a--b--icmp--0--4--84--False" and r.value == 9.0
    assert typed(spark, "latencydns", "latency,source=a,destination=b,test=icmp count=1i,rtt=9i 1", "amp2") is None
    with pytest.raises(ValueError):
        datatypes.datatype("nothing")


def test_latency_files(spark):
    r = files.latency_icmp(of(spark, "callplus-afrinic-ipv6,1391079600,462691,0.000", "broken")).collect()
    assert len(r) == 1 and (r[0].source, r[0].destination, r[0].family, r[0].value, r[0].is_lossy) == ("callplus", "afrinic", "ipv6", 462691.0, False)
    times = [str(450 + i) for i in range(10)]
    a, b, c = files.latency_smokeping(of(spark, "x.v6,1,9.9,7.000," + ",".join(times * 2), "x,1,462.624,10," + ",".join(times), "x,1,,20")).collect()
    assert (a.loss, a.median, a.family, a.is_lossy) == (0, 454.5, "ipv6", False)
    assert (b.loss, b.median, b.is_lossy) == (10, 454.5, True) and (c.loss, c.median) == (20, None)


def test_nab_files(spark):
    r = files.nab(of(spark, "timestamp,value", "2014-02-14 14:30:00,0.132")).collect()
    assert len(r) == 1 and (r[0].stream, r[0].value, r[0].time) == ("realKnown/f.csv", 0.132, datetime(2014, 2, 14, 14, 30))
    with pytest.raises(Exception, match="not two cells"):
        files.nab(of(spark, "2014-02-14 14:30:00,1,2")).collect()


def test_archive_documents(spark):
    docs = lambda x: spark.createDataFrame([("/a/b/c/key/throughput/base", json.dumps(x))], "uri string, value string")
    (r,) = files.esmond(docs([{"ts": 5, "val": 1.5}]), "simple").collect()
    assert (r.value, r.stream) == (1.5, "esmond-/a/b/c/key/throughput/base")
    (r,) = files.esmond(docs([{"ts": 5, "val": {"10.5": 3}}]), "histogram").collect()
    assert r.payload == {10.5: 3} and r.value is None
    (r,) = files.esmond(docs([{"ts": 5, "val": {"error": "no"}}]), "failure").collect()
    assert r.payload == "no"
    listing = spark.createDataFrame([("s", "d", "m", "t", [("throughput", "/base", [("/sum", "averages", 300)]), ("failures", "/f", [])])], "source string, destination string, measurement_agent string, tool_name string, event_types array<struct<event_type:string,base_uri:string,summaries:array<struct<uri:string,summary_type:string,summary_window:int>>>>")
    assert {r.uri for r in remote.discover(listing).collect()} == {"/base", "/f", "/sum"}
    assert {r.uri for r in remote.discover(listing, event_types=["throughput"], summary_window=300).collect()} == {"/sum"}
    assert remote.discover(listing, source="other").count() == 0
    assert remote.poll_interval(10) == 60 and remote.poll_interval(10**6) == 1


def test_node_tables(spark):
    nodes = files.itdk_nodes(of(spark, "# x", "node N1:  1.2.3.4 5.6.7.8 ", "node N2:  9.9.9.9")).collect()
    assert [(r.node_id, r.ip) for r in nodes] == [(1, "1.2.3.4"), (1, "5.6.7.8"), (2, "9.9.9.9")]
    r = files.itdk_as(of(spark, "node.AS N1 11814 refinement")).first()
    assert (r.node_id, r.as_number, r.method) == (1, 11814, "refinement")
    r = files.itdk_geo(of(spark, "node.geo N1:\tNA\tUS\t\tX\t1.5\t-2")).first()
    assert (r.node_id, r.region, r.city, r.latitude) == (1, None, "X", 1.5)


def test_history_and_polling(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text("".join(json.dumps({"table": "t", "time_ms": i * 1000, "stream": str(i % 2), "value": i}) + "\n" for i in range(10)))
    got = remote.history(spark, "t", 2000, 8000, 3, path=str(path))
    assert sorted(r.value for r in got.collect()) == [3, 4, 5, 6, 7, 8]
    assert sorted(r.value for r in got.where("stream = '1'").collect()) == [3, 5, 7]
    q = remote.poll(spark, "t", 4000, path=str(path)).writeStream.format("memory").queryName("polled").trigger(processingTime="0 seconds").start()
    try:
        q.processAllAvailable()
        assert sorted(r.value for r in spark.table("polled").collect()) == [5, 6, 7, 8, 9]
    finally:
        q.stop()


def test_typed_history_and_polling(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    rows = [{"table": "data_amp_icmp", "time_ms": i * 1000, "stream": 3, "loss": i % 2, "lossrate": 0.5, "median": 100 + i, "rtts": [100 + i, None]} for i in range(10)]
    rows += [{"table": "data_amp_http", "time_ms": 1, "stream": 4, "bytes": 7}]
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    icmp = datatypes.datatype("icmp")
    got = remote.typed_history(spark, icmp, 2000, 8000, 4, path=str(path)).collect()
    assert sorted((r.median, r.value, r.is_lossy, r.rtts, r.packet_size, r.stream) for r in got) == [(100 + i, 100.0 + i, bool(i % 2), [100 + i, None], None, "3") for i in range(3, 9)]
    assert remote.typed_history(spark, datatypes.datatype("http"), path=str(path)).first().value == 7.0
    # as a stream: by ranges of time, each asked for once, with a restart between
    poll = lambda now: remote.typed_poll(spark, icmp, 0, 0, path=str(path), now=str(now), step="1000", range="2000")
    for now in (4500, 20_000):
        q = poll(now).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
        found = sorted(r.median for r in spark.read.parquet(str(tmp_path / "out")).collect())
        assert found == [100 + i for i in range(1, now // 1000 + 1) if i < 10]


def test_archive_polling(spark, tmp_path):
    from pulseframe.sources import files

    uris = [f"/esmond/perfsonar/archive/{k}/throughput/base" for k in "abc"]
    path = tmp_path / "docs.jsonl"
    path.write_text("".join(json.dumps({"uri": u, "ts": t, "val": t + i / 2}) + "\n" for i, u in enumerate(uris[:2]) for t in range(1, 8)))
    got = files.esmond(remote.archive_documents(spark, uris, 2000, 5000, path=str(path)), "simple")
    assert sorted(r.value for r in got.collect()) == [3.0, 3.5, 4.0, 4.5, 5.0, 5.5]
    for now in (3000, 9000):
        docs = remote.archive_documents(spark, uris, stream=True, path=str(path), now=str(now), step="1000")
        q = files.esmond(docs, "simple").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 14


def test_traceroute_ranges(spark):
    t = spark.createDataFrame([(1, 10, None, None, [0, 5]), (1, 20, 1, None, [1]), (2, 20, None, None, [1])], "stream int, timestamp long, error_type int, error_code int, hop_rtt array<int>")
    known = spark.createDataFrame([(1,)], "stream int")
    rows = remote.traceroutes_between(t, 9, 20, [known]).orderBy("timestamp").collect()
    assert [(r.hop_rtt, r.is_lossy) for r in rows] == [([None, 5], False), ([1], True)]


FLOW = """
sources:
  net: {type: influx, subtype: amp}
sinks:
  out: {type: influx}
  table: {type: parquet}
detectors:
  b:
    type: baseline
    instances:
      - source: [{name: net, datatype: icmp, filterLossy: true}]
        sink: [{name: out}, {name: table}]
        config: {threshold: 5, maxHistory: 10, useFlinkTimeWindow: false}
"""


def test_flows_are_checked():
    flow = dag.parse(FLOW)
    assert flow.detectors["b"][0] == "baseline" and flow.detectors["b"][1][0].sources[0].filter_lossy
    for a, b in (("type: baseline", "type: nothing"), ("name: net", "name: other"), ("type: influx}\n  table", "type: odd}\n  table"), ("sinks:", "ponds:")):
        with pytest.raises(ValueError):
            dag.parse(FLOW.replace(a, b, 1))


def test_a_flow_runs_end_to_end(spark, tmp_path):
    lines = [f'data_amp_icmp,stream=3 loss=0i,median={225 if i < 40 else 22500}i,rtts="[1]" {(1_600_000_000 + i) * 10**9}' for i in range(80)]
    made = lambda kind: datatypes.of_lines(of(spark, *lines), datatypes.datatype(kind))
    flow = dag.parse(FLOW)
    found = dag.Builder(spark, tables={"net": made}).run(flow, str(tmp_path))
    direct = runtime.detect(made("icmp"), Baseline(10, 0.1, 5))
    assert found["out"].count() == direct.count() == 1
    assert spark.read.parquet(f"{tmp_path}/table").count() == 1
    assert spark.read.text(f"{tmp_path}/out/event_groups").count() == 1
    assert "in_group=" in spark.read.text(f"{tmp_path}/out/events_in_groups").first()[0]
    bad = dag.parse(FLOW.replace("subtype: amp}", "subtype: amp}").replace("type: influx, subtype: amp", "type: esmond").replace("datatype: icmp", "datatype: href"))
    with pytest.raises(ValueError, match="no value"):
        dag.Builder(spark, tables={"net": made}).events(bad)


def test_lines_are_sent_until_they_go_through(spark, tmp_path):
    log = tmp_path / "sent"

    class Send:
        def __init__(self, path):
            self.path, self.failed = str(path), False

        def __call__(self, lines):
            if not self.failed:
                self.failed = True
                raise OSError("not yet")
            with open(self.path, "a") as f:
                f.write("".join(f"{x}\n" for x in lines))

    sinks.deliver(spark.range(10).select(F.col("id").cast("string")), Send(log), 3, 0.01)
    assert sorted(map(int, log.read_text().split())) == list(range(10))


def test_pushed_lines_land_and_stream(spark, tmp_path):
    from urllib.request import Request, urlopen

    from pulseframe.sources.receiver import Receiver, pushed

    with Receiver(str(tmp_path / "in")) as r:
        for i in range(3):
            body = f'data_amp_icmp,stream={i} loss=0i,median=5i,rtts="[5]" 1000000000\nnoise\n'.encode()
            assert urlopen(Request(f"http://127.0.0.1:{r.port}/write", data=body)).status == 204
    q = pushed(spark, str(tmp_path / "in"), datatypes.datatype("icmp")).select("stream", "value").writeStream.format("memory").queryName("pushed").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((x.stream, x.value) for x in spark.table("pushed").collect()) == [("0", 5.0), ("1", 5.0), ("2", 5.0)]


def test_lines_are_parsed_once(spark):
    """Searched lines and those that only maps can say give the same, and the plan doesn't repeat the parser for each column."""
    head, ns = "data_amp_http,stream={}", 1_700_000_000_000_000_000
    lines = [
        head.format("a") + f" bytes=1i,bytes=2i,duration=3i {ns}",  # the first of a key
        head.format('"b c,d=e"') + f" bytes=,duration=4i {ns}",
        head.format("c") + f' other="x, bytes=9i",bytes=5i {ns}',
        head.format("d") + f' {"y" * 3000}=1,bytes=6i {ns}',  # long
        head.format("e\\n") + f" bytes=7i {ns}",
        head.format("f") + f" bytes=7i=8i {ns}", head.format("g") + f' bytes="7i {ns}', head.format("h") + " bytes=7i x", head.format("i") + f" bytes=7i {ns} ", f"data_amp_httpx,stream=j bytes=7i {ns}", head.format("k") + f"  bytes=7i {ns}",
        f'"data_amp_http,stream=l bytes=8i {ns}', f"data_amp_http bytes=8i {ns}", head.format("m") + f" {ns}",
    ]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    found = datatypes.of_lines(df, datatypes.datatype("http"))
    maps = df.select(text.line_protocol(F.col("value")).alias("l")).where("l.name = 'data_amp_http'").select("l.tags", "l.fields").collect()
    number = lambda x: int(x.rstrip("i")) if x and x.rstrip("i") else None
    want = {(r.tags.get("stream"), number(r.fields.get("bytes")), number(r.fields.get("duration"))) for r in maps}
    assert {(r.stream, r.bytes, r.duration) for r in found.collect()} == want and len(maps) == found.count() == 6
    kind = datatypes.datatype("throughput", "amp2")
    plan = datatypes.of_lines(df, kind)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 40_000 and plan.count("RLIKE") <= 1
