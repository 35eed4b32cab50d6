"""WARC archives: writing with revisits for equal payloads, reading back, and a globally ordered capture index.

Each record is a gzip member of its own, so the index's offsets can be sought.
The index is merged externally: each archive file gives a run of captures that
is sorted where it was read; runs are cut at common range bounds, and a loser
tree merges the runs of a range by URL key and timestamp.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseframe.llm.common import dealt_anew, quoted, scratch, written

_START = datetime(2024, 1, 1, tzinfo=UTC)
_ID = "urn:pulseframe:page:"
END = "\r\n\r\n"


def url_key(url: str | None) -> str:
    """The URL's host turned around, then port, path and query, in lower case: com,example)/a?b."""
    try:
        u = urlsplit((url or "").strip().lower())
        host, port = u.hostname or "", u.port
    except ValueError:
        return (url or "").strip().lower()
    host = ",".join(reversed(host.removeprefix("www.").split(".")))
    return f"{host}{f':{port}' if port and port not in (80, 443) else ''}){u.path or '/'}{'?' + u.query if u.query else ''}"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(record_id: str, url: str | None, html: str | None, refers_to: int | None, sha1: str, size: int, when: datetime) -> bytes:
    """One WARC record. A revisit keeps the HTTP header alone."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}{END}"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}"]
    head += [f"WARC-Record-ID: <{_ID}{record_id}>", f"WARC-Date: {when:%Y-%m-%dT%H:%M:%SZ}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))).replace('%', ''))}")
    head += [f"WARC-Payload-Digest: sha1:{sha1}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if revisit else size)}"]
    return ("\r\n".join(head) + END + http + ("" if revisit else html or "") + END).encode()


def packed(data: bytes, most: int = 1 << 23) -> bytes:
    """A record as a gzip member of its own, or several if it is over ``most`` bytes, which is under 2**24: so the last byte of each, the highest of its size, is 0."""
    out = b""
    for at in range(0, len(data), most):
        one = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += one.compress(data[at : at + most]) + one.flush()
    return out


def write_warc(
    pages: DataFrame,
    path: str,
    min_bytes: int = 0,
    records_per_file: int = 100_000,
    archive_bytes: int = 1 << 25,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> None:
    """A record for each row of pages, each a gzip member of its own, in archives under path.

    An archive ends with the record that brings it to ``archive_bytes`` bytes
    or ``records_per_file`` records. Of rows with equal payloads of at least
    ``min_bytes`` bytes, those with the largest id are responses, the others
    revisit it; shorter payloads are all responses. A payload that very many
    rows share is split over tasks. A page's capture time is its id in seconds
    from 2024 on.

    Archives are written by Spark's text writer, so any file system of
    Spark's will do: an archive is one row, and the writer's line separator is
    the zero byte that a gzip member ends with here.

    Null html is an empty payload, a null url gives no target, null ids
    revisit if any id is known for the payload, else they are responses; their
    records are told apart by a number. Rows that repeat the largest id are
    all responses. A very long payload is in its task's memory whole. An empty
    table gives no archives. Other columns are not looked at.
    """
    html = F.coalesce(F.col(quoted(html_col)), F.lit(""))
    size = F.octet_length(html).cast("long").alias("size")
    rows = pages.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(url_col)).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"), size)
    owners = rows.groupBy("sha1", "size").agg(F.max("id").alias("owner"))
    rows = rows.join(dealt_anew(owners, "sha1", "size"), ["sha1", "size"])
    refers = F.when((F.col("size") >= min_bytes) & ~F.col("id").eqNullSafe(F.col("owner")), F.col("owner"))
    rows = rows.select("id", "url", F.when(refers.isNull(), F.col("html")).alias("html"), "sha1", "size", refers.alias("refers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, nameless, held, many = TaskContext.get().partitionId(), 0, bytearray(), 0

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([bytes(held[:-1])], pa.binary())], names=["value"])

        for b in batches:
            for at in range(0, b.num_rows, 200):
                for r in b.slice(at, 200).to_pylist():
                    name = str(r["id"]) if r["id"] is not None else f"none-{task}-{nameless}"
                    nameless += r["id"] is None
                    sha1 = base64.b32encode(bytes.fromhex(r["sha1"])).decode()
                    when = _START + timedelta(seconds=(r["id"] or 0) % 10**9)
                    held += packed(record(name, r["url"], r["html"], r["refers"], sha1, r["size"], when))
                    many += 1
                    if len(held) >= archive_bytes or many >= records_per_file:
                        yield archive()
                        held, many = bytearray(), 0
        if held:
            yield archive()

    archives = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    archives.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def _member(data: memoryview, at: int, step: int = 1 << 14) -> tuple[bytes, int]:
    """What the gzip member at a place unpacks to, and where it ends."""
    one, out = zlib.decompressobj(31), []
    while not one.eof:
        if at >= len(data):
            raise ValueError("the archive ends inside a member")
        out.append(one.decompress(data[at : at + step]))
        at += step
    return b"".join(out), min(at, len(data)) - len(one.unused_data)


def _whole(raw: bytes) -> tuple[dict[str, str], bytes] | None:
    """Header and block of a record, or None if it goes on in the next member."""
    stop = raw.find(b"\r\n\r\n")
    if not raw.startswith(b"WARC/"[: len(raw)]):
        raise ValueError(f"no record: {raw[:40]!r}")
    if stop < 0:
        return None
    head = {k.lower(): v for k, v in (x.split(": ", 1) for x in raw[:stop].decode().split("\r\n")[1:])}
    end = stop + 4 + int(head["content-length"])
    if len(raw) < end + 4:
        return None
    if raw[end:] != b"\r\n\r\n":
        raise ValueError("a record doesn't end with its content")
    return head, raw[stop + 4 : end]


def records(data) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, header, block) of each record of an archive; offsets are those of the file, so a record can be read alone."""
    data, at = memoryview(data), 0
    while at < len(data):
        start, raw, found = at, b"", None
        while found is None:
            piece, at = _member(data, at)
            raw += piece
            found = _whole(raw)
        yield start, at - start, *found


RUN = (
    "run string, rank long, url_key string, captured long, page_id long, url string, record_type string, "
    "refers_to long, payload_bytes long, payload_digest string, offset long, length long"
)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The archives' captures, each archive a sorted run: rank counts its captures by URL key, time, id and offset.

    Lengths and digests of responses are taken from the payload itself, and a
    digest that the header gives otherwise is an error; revisits carry those
    of the payload that they stand for. A task holds an archive as it is and
    one unpacked record.
    """

    def page(head: dict[str, str], name: str) -> int | None:
        got = head.get(name, "").strip("<>").removeprefix(_ID)
        return int(got) if got and not got.startswith("none-") else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = []
                for offset, length, head, block in records(data.as_buffer()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    kind, sha1 = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                    size = next(int(x[15:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    if kind == "response" and (len(payload) != size or digest(payload) != sha1):
                        raise ValueError(f"{path}: the payload at {offset} isn't the one that was written")
                    url = unquote(head["warc-target-uri"]) if "warc-target-uri" in head else None
                    when = int(datetime.strptime(head["warc-date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=UTC).timestamp())
                    rows.append((url_key(url), when, page(head, "warc-record-id"), url, kind, page(head, "warc-refers-to"), size, sha1, offset, length))
                rows.sort(key=lambda r: (r[0], r[1], -1 if r[2] is None else r[2], r[8]))
                if rows:
                    columns = [pa.array([path] * len(rows)), pa.array(range(len(rows)), pa.int64())]
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                    columns += [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in RUN.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, RUN)


class LoserTree:
    """The smallest of k sorted runs, one after the other: a replay costs one comparison per level.

    ``keys[i]`` is run i's sorted list; equal keys come by run. Iterating
    gives (run, place in it).
    """

    def __init__(self, keys: list[list]):
        self.keys, self.k = keys, len(keys)
        self.at = [0] * self.k
        self.tree = [-1] * max(1, self.k)
        for run in range(self.k):
            self._replay(run)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.at[a] < len(self.keys[a]), self.at[b] < len(self.keys[b])
        if not (x and y):
            return x
        p, q = self.keys[a][self.at[a]], self.keys[b][self.at[b]]
        return p < q or p == q and a < b

    def _replay(self, run: int) -> None:
        node, winner = (run + self.k) // 2, run
        while node:
            rival = self.tree[node]
            if rival < 0:
                self.tree[node] = winner
                return
            if self._before(rival, winner):
                self.tree[node], winner = winner, rival
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple[int, int]]:
        for _ in range(sum(map(len, self.keys))):
            run = self.tree[0]
            yield run, self.at[run]
            self.at[run] += 1
            self._replay(run)


def merge_index(runs: DataFrame, rows_per_range: int = 10_000, most_ranges: int = 20_000) -> DataFrame:
    """The captures of all runs in global order, by URL key, time and id: range_id, position in the range, and place among all.

    Range bounds are quantiles of a sample of about 20 keys a range (at most
    ``most_ranges`` ranges); the whole key is unique by file and offset, so a
    URL with very many captures is cut too. Each range's pieces of runs are
    merged by a loser tree, in one task's memory: ``rows_per_range`` captures
    or so, more only beyond the product of both bounds. An empty table gives
    no rows.
    """
    total = runs.count()
    ranges = max(1, min(most_ranges, -(-total // rows_per_range)))
    step = max(1, total // (20 * ranges))
    sample = runs.where(F.pmod(F.xxhash64("run", "rank"), F.lit(step)) == 0).select("url_key", "captured", F.coalesce("page_id", F.lit(-1)), "run", "offset").collect()
    sample = sorted(map(tuple, sample))
    bounds = [sample[i * len(sample) // ranges] for i in range(1, ranges)] if sample else []

    def keys(t: pa.RecordBatch | pa.Table) -> list[tuple]:
        page = [-1 if x is None else x for x in t.column("page_id").to_pylist()]
        return list(zip(t.column("url_key").to_pylist(), t.column("captured").to_pylist(), page, t.column("run").to_pylist(), t.column("offset").to_pylist(), strict=True))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([bisect.bisect_right(bounds, k) for k in keys(b)], pa.int64())], names=[*b.schema.names, "range_id"])

    def merge(t: pa.Table) -> pa.Table:
        t = t.sort_by([("run", "ascending"), ("rank", "ascending")])  # the runs as they were, one after the other
        key, run = keys(t), t.column("run").to_pylist()
        starts = [i for i in range(len(run)) if i == 0 or run[i] != run[i - 1]] + [len(run)]
        order = [starts[r] + at for r, at in LoserTree([key[x:y] for x, y in zip(starts, starts[1:], strict=False)])]
        return t.take(pa.array(order, pa.int64())).append_column("position", pa.array(range(len(order)), pa.int64()))

    dealt = runs.mapInArrow(deal, f"{RUN}, range_id long")
    merged = dealt.groupBy("range_id").applyInArrow(merge, f"{RUN}, range_id long, position long")
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # one row a range
    sizes = dealt.groupBy(F.col("range_id").alias("_range")).agg(F.count("*").alias("_n"))
    sizes = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    merged = merged.join(sizes, F.col("range_id") == F.col("_range")).withColumn("place", F.col("_before") + F.col("position"))
    return merged.drop("_range", "_before")


def archive(pages: DataFrame, path: str | None = None, **kw) -> DataFrame:
    """Writes pages as archives under path (by default in the session's shared scratch folder), reads them back and gives the merged index."""
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    write_warc(pages, path, **kw)
    return merge_index(written(read_runs(spark, path), "warc-runs"))
