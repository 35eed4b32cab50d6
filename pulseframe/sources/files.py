"""File sources, batch and streaming: latency time series, NAB files, line protocol, REST documents, node tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.functions.text import utc_timestamp
from pulseframe.sources.datatypes import Datatype, of_lines


def lines(spark: SparkSession, path: str, pattern: str | None = None, stream: bool = False, per_trigger: int | None = None) -> DataFrame:
    """The lines of all files under path (column value), with their file; ``stream`` follows the folder."""
    reader = (spark.readStream if stream else spark.read).format("text").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if stream and per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.load(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def latency_icmp(raw: DataFrame) -> DataFrame:
    """source-destination-family,epoch seconds,average,loss rate. The stream is the first cell, so it needs no numbering across files."""
    p = F.split("value", ",", -1)
    key = F.split(p[0], "-", -1)
    rows = raw.where(F.size(p) == 4)
    return rows.select(p[0].alias("stream"), F.timestamp_seconds(p[1].try_cast("bigint")).alias("time"), F.lit(0).cast("long").alias("seq"), key[0].alias("source"), F.array_join(F.slice(key, 2, F.size(key) - 2), "-").alias("destination"), F.element_at(key, -1).alias("family"), p[2].try_cast("int").alias("average"), p[3].try_cast("double").alias("lossrate")).withColumns({"value": F.col("average").cast("double"), "is_lossy": F.coalesce(F.col("lossrate") > 0, F.lit(True)), "datatype": F.lit("ampicmp")})


def latency_smokeping(raw: DataFrame, pings: int = 20) -> DataFrame:
    """destination,epoch seconds,median,loss,times... Median (three decimals) and loss are made anew from the times."""
    p = F.split("value", ",", -1)
    times = F.array_sort(F.filter(F.transform(F.slice(p, F.lit(5), F.greatest(F.size(p) - 4, F.lit(0))), lambda x: F.trim(x).try_cast("double")), lambda x: x.isNotNull()))
    rows = raw.where(F.size(p) >= 4).select(p[0].alias("stream"), p[0].alias("destination"), F.timestamp_seconds(p[1].try_cast("bigint")).alias("time"), F.lit(0).cast("long").alias("seq"), times.alias("results"))
    n = F.size("results")
    half = F.floor(n / 2).cast("int")
    middle = F.when(n == 0, None).when(n % 2 == 1, F.try_element_at("results", half + 1)).otherwise((F.try_element_at("results", F.greatest(half, F.lit(1))) + F.try_element_at("results", half + 1)) / 2)
    family = F.when(F.col("destination").contains("v6"), "ipv6").otherwise("ipv4")
    return rows.withColumns({"median": F.round(middle, 3), "loss": F.lit(pings) - n, "family": family}).withColumns({"value": F.col("median"), "is_lossy": F.col("loss") > 0, "datatype": F.lit("smokeping")})


def nab(raw: DataFrame) -> DataFrame:
    """timestamp,value with a header; the stream is folder/file. A line of other than two cells is an error."""
    p = F.split("value", ",", -1)
    parts = F.split("file", "/")
    stream = F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1))
    rows = raw.where(~F.col("value").startswith("timestamp") & (F.trim("value") != ""))
    cell = F.when(F.size(p) == 2, p[1].cast("double")).otherwise(F.raise_error(F.concat(F.lit("not two cells: "), F.col("value"))))
    return rows.select(stream.alias("stream"), utc_timestamp(p[0], "yyyy-MM-dd HH:mm:ss").alias("time"), F.lit(0).cast("long").alias("seq"), cell.alias("value"), F.lit(False).alias("is_lossy"), F.lit("nab").alias("datatype"))


def line_measurements(raw: DataFrame, kind: Datatype) -> DataFrame:
    return of_lines(raw, kind)


# The response kinds of archive time series, by event type.
RESPONSE_KINDS = {
    "failures": "failure", "histogram-owdelay": "histogram", "histogram-rtt": "histogram", "histogram-ttl": "histogram", "histogram-ttl-reverse": "histogram", "packet-count-lost": "simple", "packet-count-lost-bidir": "simple", "packet-count-sent": "simple",
    "packet-duplicates": "simple", "packet-duplicates-bidir": "simple", "packet-loss-rate": "simple", "packet-loss-rate-bidir": "simple", "packet-reorders": "simple", "packet-reorders-bidir": "simple", "packet-retransmits": "simple",
    "packet-retransmits-subintervals": "subinterval", "packet-trace": "packettrace", "path-mtu": "simple", "pscheduler-run-href": "href", "streams-packet-retransmits": "subinterval", "streams-throughput": "subinterval", "throughput": "simple",
    "throughput-subintervals": "subinterval", "time-error-estimates": "simple",
}
RESPONSES = {
    "simple": "ts long, val double",
    "failure": "ts long, val struct<error:string>",
    "href": "ts long, val struct<href:string>",
    "histogram": "ts long, val map<string,int>",
    "packettrace": "ts long, val array<struct<success:int,ip:string,hostname:string,rtt:string,ttl:string,query:int,error_message:string,mtu:string,as:struct<owner:string,number:int>>>",
    "subinterval": "ts long, val array<struct<start:string,duration:string,val:string>>",
}


def esmond(documents: DataFrame, kind: str, column: str = "value") -> DataFrame:
    """Time series documents (a JSON array each, with uri beside it) as measurements of one response kind."""
    rows = documents.select("uri", F.explode(F.from_json(column, f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in _fields(RESPONSES[kind]))}>>")).alias("e"))
    out = rows.select(F.concat(F.lit("esmond-"), "uri").alias("stream"), F.timestamp_seconds("e.ts").alias("time"), F.lit(0).cast("long").alias("seq"), F.col("e.val").alias("payload"), F.lit(False).alias("is_lossy"), F.lit(kind).alias("datatype"))
    if kind == "simple":
        return out.withColumn("value", F.col("payload"))
    if kind == "histogram":
        out = out.withColumn("payload", F.transform_keys("payload", lambda k, _: k.cast("double")))
    if kind in ("failure", "href"):
        out = out.withColumn("payload", F.col("payload").getField("error" if kind == "failure" else "href"))
    return out.withColumn("value", F.lit(None).cast("double"))


def _fields(ddl: str) -> list[str]:
    return [ddl[: ddl.index(",")], ddl[ddl.index(",") + 2 :]]


def itdk_nodes(raw: DataFrame) -> DataFrame:
    """node N<id>:  ip ip ... as (node_id, ip)."""
    rows = raw.where(~F.col("value").startswith("#") & F.col("value").startswith("node N"))
    return rows.select(F.regexp_extract("value", r"^node N(\d+):", 1).cast("long").alias("node_id"), F.explode(F.filter(F.split(F.regexp_replace("value", r"^node N\d+:\s*", ""), r"\s+"), lambda x: x != "")).alias("ip"))


def itdk_as(raw: DataFrame) -> DataFrame:
    """node.AS N<id> <asn> <method>."""
    p = F.split("value", r"\s+")
    return raw.where(F.col("value").startswith("node.AS ")).select(F.regexp_extract(p[1], r"N(\d+)", 1).cast("long").alias("node_id"), p[2].try_cast("int").alias("as_number"), F.try_element_at(p, F.lit(4)).alias("method"))


def itdk_geo(raw: DataFrame) -> DataFrame:
    """node.geo N<id>: and tab-separated places; blanks are null."""
    p = F.split("value", "\t", -1)
    cell = lambda i: F.nullif(F.trim(F.try_element_at(p, F.lit(i + 1))), F.lit(""))
    names = ("continent", "country", "region", "city", "latitude", "longitude")
    return raw.where(F.col("value").startswith("node.geo ")).select(F.regexp_extract(p[0], r"N(\d+)", 1).cast("long").alias("node_id"), *((cell(i).try_cast("float") if n.endswith("tude") else cell(i)).alias(n) for i, n in enumerate(names, 1)))
