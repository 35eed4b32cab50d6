"""The measurement types: how each is named, which columns it has, which is its value, when it counts as lost.

Fixed values below: names of tables, fields and tags as the monitored systems
write them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.functions import text

_FLAGS = ("flag_aa", "flag_ad", "flag_cd", "flag_qr", "flag_ra", "flag_rd", "flag_tc")


@dataclass(frozen=True)
class Datatype:
    """fields: name to kind (int, float, bool, string, rtts). lossy: SQL over the fields. tags: parts of a composed stream name."""

    name: str
    table: str
    fields: dict[str, str]
    value: str | None
    lossy: str
    tags: tuple[str, ...] = ()
    family: str = "amp"


def _ints(*names: str) -> dict[str, str]:
    return dict.fromkeys(names, "int")


_PING = _ints("loss") | {"lossrate": "float"} | _ints("median", "packet_size", "results") | {"rtts": "rtts"}
AMP = (
    Datatype("icmp", "data_amp_icmp", _PING, "median", "coalesce(loss, 100) > 0"),
    Datatype("dns", "data_amp_dns", dict.fromkeys(_FLAGS, "bool") | {"lossrate": "float"} | _ints("opcode", "query_len", "rcode", "requests", "response_size", "rtt", "total_additional", "total_answer", "total_authority", "ttl"), "rtt", "coalesce(lossrate, 1.0) > 0"),
    Datatype("http", "data_amp_http", _ints("bytes", "duration", "object_count", "server_count"), "bytes", "bytes IS NULL"),
    Datatype("tcpping", "data_amp_tcpping", _ints("icmperrors") | _PING, "median", "coalesce(loss, 100) > 0"),
    Datatype("traceroutepathlen", "data_amp_traceroute_pathlen", {"path_length": "float"}, "path_length", "false"),
)


def _amp2(name: str, measurement: str, tags: str, fields: dict[str, str], value: str) -> Datatype:
    return Datatype(name, measurement, fields, value, f"{value} IS NULL", ("source", "destination", "test", *tags.split()), "amp2")


def _floats(*names: str) -> dict[str, str]:
    return dict.fromkeys(names, "float")


AMP2 = (
    _amp2("external", "external", "command", _ints("count") | _floats("value"), "value"),
    _amp2("fastping", "fastping", "dscp family packet_count packet_rate packet_size", _ints("count") | _floats("jitter", "loss_percent", "rtt"), "rtt"),
    _amp2("http", "http", "caching", _ints("bytes", "count", "duration", "object_count", "server_count"), "bytes"),
    _amp2("latencydns", "latency", "dscp family query", _ints("count", "error_code", "error_type", "icmpcode", "icmptype", "loss", "rtt"), "rtt"),
    _amp2("latencyicmp", "latency", "dscp family packet_size random", _ints("count", "error_code", "error_type", "icmpcode", "icmptype", "loss", "rtt"), "rtt"),
    _amp2("latencytcpping", "latency", "dscp family packet_size port random", _ints("count", "error_code", "error_type", "icmpcode", "icmptype", "loss", "rtt"), "rtt"),
    _amp2("pathlen", "pathlen", "dscp family packet_size random", _ints("length"), "length"),
    _amp2("sip", "sip", "dscp family uri", _ints("connect_time", "count", "duration", "response_time", "rtt", "rx_jitter", "tx_jitter") | _floats("rx_loss_percent", "tx_loss_percent"), "rtt"),
    _amp2("throughput", "throughput", "direction dscp family protocol write_size", _ints("bytes", "count") | {"duration": "string"} | _ints("runtime"), "bytes"),
    _amp2("traceroute", "traceroute", "dscp family hop packet_size random", {"address": "string"} | _ints("rtt"), "rtt"),
    _amp2("udpstream", "udpstream", "direction dscp family packet_count packet_size packet_spacing", _ints("count", "jitter", "loss", "rtt") | _floats("mos"), "rtt"),
    _amp2("video", "video", "requested_quality", {"actual_quality": "string"} | _ints("count", "initial_buffering", "playing_time", "pre_time", "stall_count", "stall_time"), "playing_time"),
)
_GEO = ("city", "country", "country_code", "geohash", "latitude", "longitude")
FLOW = Datatype(
    "flow", "flow_statistics",
    {"flow_id": "int", "start_ts": "int", "end_ts": "int", "duration": "float", "ttfb": "float", "in_bytes": "int", "out_bytes": "int"}
    | {f"{side}_{x}": "float" if x in ("latitude", "longitude") else "string" for side in ("src", "dst") for x in ("ip", *_GEO)} | {"src_port": "int", "dst_port": "int"},
    "ttfb", "false", ("capture_application", "capture_host", "category", "protocol", "type"), "bigdata",
)
DATATYPES = {(d.family, d.name): d for d in (*AMP, *AMP2, FLOW)}

_CASTS = {"int": text.int_field, "float": text.float_field, "bool": text.bool_field, "string": text.string_field, "rtts": text.rtt_list}


def datatype(name: str, family: str = "amp") -> Datatype:
    """By name within a family, since both families have an http."""
    try:
        return DATATYPES[family, "flow" if (family, name) == ("bigdata", "flow_statistics") else name]
    except KeyError:
        raise ValueError(f"no datatype {name} in {family}") from None


def of_lines(lines: DataFrame, kind: Datatype, column: str = "value") -> DataFrame:
    """The measurements of that type among lines of line protocol, typed, with stream, time, value and is_lossy. Other lines and broken ones are left out."""
    # what a generator gives is neither inlined nor filtered before it, so that each step is done once a line
    once = lambda df, c, name: df.select(F.explode(F.array(c)).alias(name))
    line = F.col("_line")
    rows = once(lines, F.col(column), "_line").where(line.startswith(kind.table) & (text.unusual_line(line) | text.sound_line(line, kind.table)))
    # nearly all lines are searched for the columns that are wanted; only unusual ones become maps
    hard = F.when(text.unusual_line(line), text.line_protocol(line))
    ms = F.when(text.unusual_line(line), F.when(hard["name"] == kind.table, hard["time_ms"])).otherwise(text.ns_to_ms(text.line_part(line, 3).try_cast("bigint")))
    rows = once(rows, F.struct(text.line_part(line, 1).alias("head"), text.line_part(line, 2).alias("body"), ms.alias("ms"), text.unusual_line(line).alias("unusual"), hard.alias("hard")), "_l").where("_l.ms is not null")
    if kind.table == "latency":
        rows = rows.where(_found(kind, "test") == kind.name.removeprefix("latency"))
    return measured(rows.select(*_columns(kind), F.timestamp_millis("_l.ms").alias("time"), _stream(kind).alias("stream")), kind)


def _found(kind: Datatype, name: str, then=lambda c: c) -> Column:
    """A tag or field of the line _l. A function of its own: looked up side by side in one they would make more code than Java compiles."""
    part, entries = ("head", "tags") if name in kind.tags or name == "stream" else ("body", "fields")
    return text.bound(F.col("_l"), lambda x: then(F.when(x["unusual"], x["hard"][entries][name]).otherwise(text.line_value(x[part], name))))


def _columns(kind: Datatype) -> list[Column]:
    names = dict.fromkeys(kind.tags, "string") | kind.fields
    return [(_found(kind, n) if n in kind.tags else _found(kind, n, _CASTS[k])).alias(n) for n, k in names.items()]


def _stream(kind: Datatype) -> Column:
    if kind.family == "amp":
        return _found(kind, "stream")
    if kind.family == "bigdata":
        return _found(kind, "flow_id", lambda c: F.regexp_replace(c, "i$", ""))
    return text.compose_stream(F.lit(kind.table), *(F.coalesce(_found(kind, t), F.lit("")) for t in kind.tags))


def measured(rows: DataFrame, kind: Datatype) -> DataFrame:
    """Typed rows with datatype, value and is_lossy."""
    value = F.lit(None).cast("double") if kind.value is None else F.col(kind.value).cast("double")
    if kind.name == "throughput":
        rows = rows.withColumn("bytes_per_runtime", F.try_divide("bytes", "runtime"))
    return rows.withColumns({"value": value, "is_lossy": F.expr(kind.lossy), "datatype": F.lit(kind.name), "seq": F.lit(0).cast("long")})


# Metadata columns of the relational dimension tables, by type.
METAS = {
    "icmp": ("source", "destination", "family", "packet_size_selection"),
    "dns": ("source", "destination", "instance", "address", "query", "query_type", "query_class", "udp_payload_size", "recurse", "dnssec", "nsid"),
    "http": ("source", "destination", "max_connections", "max_connections_per_server", "max_persistent_connections_per_server", "pipelining_max_requests", "persist", "pipelining", "caching"),
    "tcpping": ("source", "destination", "port", "family", "packet_size_selection"),
    "traceroute": ("source", "destination", "family", "packet_size_selection"),
}


def rich(rows: DataFrame, meta: DataFrame, name: str) -> DataFrame:
    """Measurements of a type with its metadata columns; those whose stream has none are dropped."""
    meta = meta.select(F.col("stream").cast("string").alias("stream"), *(c for c in METAS[name] if c in meta.columns))
    return rows.join(meta.withColumnsRenamed({c: f"meta_{c}" for c in METAS[name] if c in rows.columns}), "stream")
