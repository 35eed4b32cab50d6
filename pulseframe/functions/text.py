"""Scalar functions over text formats: line protocol, CSV, paths, numbers. All are column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A separator outside quotes: an even number of quotes follows it.
UNQUOTED = r"(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)"


def quoted_split(c: Column, separators: str = ", ") -> Column:
    """The parts of c between separators outside quotes; quotes have no escapes."""
    return F.split(c, f"[{separators}]{UNQUOTED}", -1)


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c, which is worked out once a row however often f names it."""
    return F.transform(F.array(c), f)[0]


def _unquoted(c: Column, separator: str) -> Column:
    """The parts of c between one separator outside quotes; without quotes no regular expression is needed."""
    return F.when(F.contains(c, F.lit('"')), F.split(c, f"{separator}{UNQUOTED}", -1)).otherwise(F.split(c, separator, -1))


def line_protocol(line: Column) -> Column:
    """A line as struct(name, tags, fields, time in ms), or null if it isn't one: a k=v of other than two parts spoils the whole line.

    Times of ns are cut to ms. Each part is split once: what is used more than
    once is bound, since these expressions are not shared otherwise.
    """
    pairs = lambda a: F.transform(a, lambda kv: _unquoted(kv, "="))
    sound = lambda a: F.forall(a, lambda x: F.size(x) == 2)
    entries = lambda a: F.map_from_entries(_first_of_key(F.transform(a, lambda x: F.struct(x[0].alias("key"), x[1].alias("value")))))

    def of_parts(parts: Column) -> Column:
        head, fields, time = (F.try_element_at(parts, F.lit(i)) for i in (1, 2, 3))
        split = F.struct(_unquoted(head, ",").alias("names"), pairs(_unquoted(fields, ",")).alias("fields"), time.try_cast("bigint").alias("ns"))
        return F.when(F.size(parts) == 3, bound(split, of_split))

    def of_split(s: Column) -> Column:
        return bound(pairs(F.slice(s["names"], F.lit(2), F.greatest(F.size(s["names"]) - 1, F.lit(0)))), lambda tags: F.when(sound(tags) & sound(s["fields"]) & s["ns"].isNotNull(), whole(s, tags)))

    def whole(s: Column, tags: Column) -> Column:
        return F.struct(F.element_at(s["names"], 1).alias("name"), entries(tags).alias("tags"), entries(s["fields"]).alias("fields"), ns_to_ms(s["ns"]).alias("time_ms"))

    return bound(_unquoted(line, " "), of_parts)


def _first_of_key(entries: Column) -> Column:
    """Entries whose key hasn't come before: the first of a key counts."""
    once = lambda s: F.filter(s["entries"], lambda x, i: F.array_position(s["keys"], x["key"]) == i + 1)
    return bound(entries, lambda a: bound(F.struct(a.alias("entries"), a["key"].alias("keys")), once))


# Parts of a line in which quotes are closed: up to a space, an item up to a comma, a key or value. Possessive, so they take linear time.
_PART, _ITEM, _TOKEN = (f'[^{x}"]*+(?:"[^"]*+"[^{x}"]*+)*+' for x in (" ", ",", " ,="))
_PAIR = f"{_TOKEN}={_TOKEN}"


def unusual_line(line: Column) -> Column:
    """Whether a quote is left open, or the line is so long that expressions would nest too deep; such lines are for ``line_protocol`` alone."""
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
    return (F.length(line) > 2048) | (quotes % 2 == 1)


def sound_line(line: Column, name: str) -> Column:
    """Whether a line that isn't unusual is one of that name by the rules of ``line_protocol``."""
    return line.rlike(rf"\A{name}(?:,{_PAIR})*+ {_PAIR}(?:,{_PAIR})*+ {_PART}\z")


def line_part(line: Column, i: int) -> Column:
    """The tags with the name (1), fields (2) or time (3) of a sound line."""
    return F.regexp_extract(line, rf"\A({_PART}) ({_PART}) ({_PART})\z", i)


def line_value(part: Column, key: str) -> Column:
    """The value of a key, the first if there are several, in the tags or fields of a sound line; null without it."""
    return F.try_element_at(F.regexp_extract_all(part, F.lit(rf"\A(?:{_ITEM},)*?{key}=({_TOKEN})(?:,|\z)"), F.lit(1)), F.lit(1))


def ns_to_ms(ns: Column) -> Column:
    return F.round((ns - F.pmod(ns, F.lit(1_000_000))) / 1_000_000).cast("bigint")  # a double holds the quotient, not ns itself


def int_field(c: Column) -> Column:
    """An integer field, with or without its i."""
    return F.regexp_replace(c, "i$", "").try_cast("bigint")


def float_field(c: Column) -> Column:
    return F.regexp_replace(c, "i$", "").try_cast("double")


def string_field(c: Column) -> Column:
    return F.regexp_replace(c, '^"|"$', "")


def bool_field(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.isin("t", "true"), True).when(low.isin("f", "false"), False)


def rtt_list(c: Column) -> Column:
    """"[1, None]" as an array of integers, None as null."""
    inner = F.trim(F.regexp_replace(string_field(c), r"^\[|\]$", ""))
    numbers = lambda t: F.when(t == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(t, ","), lambda x: F.trim(x).try_cast("int")))
    return F.when(c.isNotNull(), bound(inner, numbers))


def inet_list(c: Column) -> Column:
    """"{a,NULL,b}" as an array of addresses."""
    inner = F.regexp_replace(c, r"^\{|\}$", "")
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(inner, ","), lambda x: F.nullif(F.trim(x), F.lit("NULL"))))


def as_path(c: Column) -> Column:
    """"{2.681,1.-2}" as an array of AS numbers, each as often as its count says."""
    inner = F.regexp_replace(c, r"^\{|\}$", "")
    entry = lambda x: F.array_repeat(F.substring_index(F.trim(x), ".", -1).try_cast("int"), F.substring_index(F.trim(x), ".", 1).cast("int"))
    return F.when(inner == "", F.array().cast("array<int>")).otherwise(F.flatten(F.transform(F.split(inner, ","), entry)))


def as_category(c: Column) -> Column:
    return F.when(c == -2, "private").when(c == -1, "missing").when(c == 0, "unknown").otherwise("valid")


def zip_hops(addresses: Column, numbers: Column | None) -> Column:
    """Hops as struct(address, as_number), to the shorter of both; without AS numbers all are missing (-1)."""
    missing = F.transform(addresses, lambda _: F.lit(-1))
    n = missing if numbers is None else F.coalesce(numbers, missing)
    size = F.least(F.size(addresses), F.size(n))
    pairs = F.transform(addresses, lambda a, i: F.struct(a.alias("address"), F.try_element_at(n, i + 1).alias("as_number")))
    return F.when(size > 0, F.slice(pairs, F.lit(1), size)).otherwise(F.slice(pairs, 1, 0))


def direction(c: Column) -> Column:
    """in or out, whatever the case; anything else is an error."""
    low = F.lower(c)
    return F.when(low.isin("in", "out"), low).otherwise(F.raise_error(F.concat(F.lit("no direction: "), F.coalesce(c, F.lit("null")))))


def compose_stream(*parts: Column) -> Column:
    return F.concat_ws("--", *parts)


def stream_tags(stream: Column) -> Column:
    """The tags that a composed stream name carries, or null with under four parts."""
    tags = lambda p: F.when(F.size(p) >= 4, F.create_map(F.lit("measurement_type"), p[0], F.lit("source"), p[1], F.lit("destination"), p[2], F.lit("test"), p[3]))
    return bound(F.split(stream, "--", -1), tags)


def event_line(table: str | None = None) -> Column:
    """Events as line protocol: tags and fields in order of their names, times in ns."""
    own = F.map_concat(F.col("tags"), F.coalesce(stream_tags(F.col("stream")), F.create_map().cast("map<string,string>")), F.create_map(F.lit("stream"), F.col("stream"), F.lit("event_type"), F.col("event_type")))
    tags = F.array_sort(F.transform(F.map_entries(own), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    fields = F.concat(F.lit('description="'), F.col("description"), F.lit('",detection_latency='), F.col("detection_latency").cast("string"), F.lit("i,severity="), F.col("severity").cast("string"), F.lit("i"))
    head = F.array_join(tags, ",") if table is None else F.concat(F.lit(f"{table},"), F.array_join(tags, ","))
    return F.concat_ws(" ", head, fields, (F.unix_millis("time") * 1_000_000).cast("string"))


def duration_text(nanos: Column) -> Column:
    """H:mm:ss.SSS."""
    ms = F.floor(nanos / 1_000_000)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(F.floor(ms / 3_600_000).cast("string"), F.lit(":"), two(F.floor(ms / 60_000) % 60), F.lit(":"), two(F.floor(ms / 1000) % 60), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))


def csv_entry(c: Column, kind: str) -> Column:
    """A CSV cell: null is empty, arrays are joined by ";" in quotes, times are ms since 1970."""
    if kind.startswith("array"):
        return F.concat(F.lit('"'), F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit(""))), ";"), F.lit('"'))
    return F.coalesce((F.unix_millis(c) if kind == "timestamp" else c).cast("string"), F.lit(""))


def csv_line(df) -> Column:
    return F.concat_ws(",", *(csv_entry(F.col(f.name), f.dataType.simpleString()) for f in df.schema.fields))


def event_csv() -> Column:
    tags = F.array_join(F.array_sort(F.transform(F.map_entries("tags"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return F.concat_ws(",", "event_type", "stream", F.col("severity").cast("string"), F.unix_millis("time").cast("string"), duration_text(F.col("detection_latency")), "description", F.concat(F.lit('"'), tags, F.lit('"')))


def group_line() -> Column:
    """Groups with their aggregates and uid as line protocol; a group without an end is still going on."""
    n = lambda c: F.concat(c.cast("string"), F.lit("i"))
    tags = F.concat_ws(",", F.concat(F.lit("endTime="), n(F.unix_millis("end_time") * 1_000_000)), F.concat(F.lit("uid="), F.col("uid")))
    seconds = F.floor(F.col("duration_s"))
    text = F.when(F.col("end_time").isNull(), "Event group still in progress.").otherwise(F.concat(F.lit("Group of "), F.col("event_count"), F.lit(" events over "), F.col("stream_count"), F.lit(" measurement streams with duration PT"), seconds, F.lit('S, most common event type "'), F.col("mode_event_type"), F.lit('", mean severity '), F.col("mean_severity"), F.lit(", and mean detection latency PT"), F.floor(F.col("mean_detection_latency") / 1_000_000_000), F.lit("S")))
    fields = F.concat(F.lit("meanDetectionLatency="), n(F.col("mean_detection_latency")), F.lit(",meanSeverity="), n(F.col("mean_severity")), F.lit(',modeEventType="'), F.col("mode_event_type"), F.lit('",event_count='), n(F.col("event_count")), F.lit(',description="'), text, F.lit('"'))
    return F.concat_ws(" ", F.when(tags == "", "still_ongoing=true").otherwise(tags), fields, (F.unix_millis("start_time") * 1_000_000).cast("string"))


def ipv4_number(c: Column) -> Column:
    """The address as a number, so that order goes by octets."""
    p = F.split(c, r"\.")
    return F.when(F.size(p) == 4, p[0].cast("long") * 16777216 + p[1].cast("long") * 65536 + p[2].cast("long") * 256 + p[3].cast("long"))


def metadata_key(uri: Column) -> Column:
    """The archive key in a URI such as /esmond/perfsonar/archive/<key>/<event type>/base."""
    return F.element_at(F.split(uri, "/"), 5)


def uri_event_type(uri: Column) -> Column:
    return F.element_at(F.split(uri, "/"), 6)


# Names of summary types in URIs and in requests.
SUMMARY_NAMES = {"aggregations": "aggregation", "averages": "average", "statistics": "statistics"}


def summary_type(c: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in SUMMARY_NAMES.items() for x in kv))[c]


def utc_timestamp(c: Column, pattern: str) -> Column:
    """A time written without its zone, taken as UTC whatever the session's zone is."""
    ms = F.timestamp_diff("MILLISECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), F.to_timestamp_ntz(c, F.lit(pattern)))
    return F.timestamp_millis(ms)
