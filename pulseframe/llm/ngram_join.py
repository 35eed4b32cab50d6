"""N-gram Jaccard join: which documents reach each other by links of similar word n-grams.

A document is its set of word n-grams. Sets that are alike are one class. A
pair over the threshold must share an n-gram among the first few of both sets
when these are ordered rare first; so the classes are joined on these prefix
n-grams, with length and positional filters, and each pair is verified once,
behind a suffix filter, on the whole texts.

What is asked for are the components, so a pair within a component that
earlier links have made needn't be verified: the first rounds only pair each
class with one leader of each shared n-gram, the last pairs all that are still
apart. A group of near copies thus costs about its size, not its square.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.common import Scratch, components, dealt_anew, fresh, give_back, kind_of, quoted

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
CHUNKS = 64


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's n-grams of ``words`` words, A-Z lower-cased; with fewer words, of all together."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(w), len(w))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    n = len(w) - words + 1
    with np.errstate(over="ignore"):
        s = h[:n].copy()
        for i in range(1, words):
            s = (s ^ (s >> np.uint64(31))) * _A + h[i : n + i]
        s = (s ^ (s >> np.uint64(29))) * _B
        s ^= s >> np.uint64(32)
    return np.unique(s)


def least_common(size: int, share: int) -> int:
    """ceil(share / 100 * size), exactly."""
    return -(-share * size // 100)


def pair_common(a: int, b: int, share: int) -> int:
    """The least intersection at which 100 * intersection >= share * union, for sets of sizes a and b."""
    return -(-share * (a + b) // (100 + share))


def suffix_passes(x: np.ndarray, y: np.ndarray, most: int, depth: int = 3) -> bool:
    """Whether a lower bound of the symmetric difference of two sorted sets is at most ``most``: both are split at a pivot, and the halves' sizes bound it."""
    if abs(len(x) - len(y)) > most:
        return False
    if not depth or not len(x) or not len(y):
        return True
    pivot = y[len(y) // 2]
    i, j = int(np.searchsorted(x, pivot)), len(y) // 2
    left, right = abs(i - j), abs((len(x) - i) - (len(y) - j))
    if left + right > most:
        return False
    return suffix_passes(x[:i], y[:j], most - right, depth - 1) and suffix_passes(x[i:], y[j:], most - left, depth - 1)


def similar(x: np.ndarray, y: np.ndarray, share: int) -> bool:
    least = pair_common(len(x), len(y), share)
    if min(len(x), len(y)) < least or not suffix_passes(x, y, len(x) + len(y) - 2 * least):
        return False
    return len(np.intersect1d(x, y, assume_unique=True)) >= least


def frequency_classes(docs: DataFrame, words: int, bits: int = 20, text_col: str = "text") -> np.ndarray:
    """How often n-grams occur, roughly: 2**bits counters by the upper bits of their hash, on a logarithmic scale of a byte each.

    A counter is never below the number of documents of any of its n-grams.
    The size is fixed, so it can be broadcast whatever the input; tasks send
    their counters in pieces, which are summed as they stream in.
    """
    part = 1 << bits >> 6

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        total = np.zeros(1 << bits, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 200):
                s = [shingles(t, words) for t in b.column(0).slice(at, 200).to_pylist()]
                total += np.bincount((np.concatenate(s) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        pieces, kinds = [], []
        for k in range(CHUNKS):
            piece = total[k * part : (k + 1) * part]
            at = np.flatnonzero(piece)
            if len(at) * 3 < part:
                pieces.append(at.astype("<u4").tobytes() + piece[at].astype("<i8").tobytes())
                kinds.append(0)
            else:
                kinds.append(2 if piece.max() < 1 << 16 else 8)
                pieces.append(piece.astype(f"<u{kinds[-1]}").tobytes())
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array(kinds, pa.int32()), pa.array(pieces, pa.binary())], names=["chunk", "kind", "piece"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, kind, piece in zip(*(c.to_pylist() for c in b.columns), strict=True):
                to = total.setdefault(chunk, np.zeros(part, np.int64))
                if kind:
                    to += np.frombuffer(piece, f"<u{kind}").astype(np.int64)
                else:
                    n = len(piece) // 12
                    to[np.frombuffer(piece[: 4 * n], "<u4")] += np.frombuffer(piece[4 * n :], "<i8")
        if total:
            classes = [np.minimum(255, 4 * np.log2(1 + x)).astype(np.uint8).tobytes() for x in total.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(classes, pa.binary())], names=["chunk", "classes"])

    pieces = docs.select(text_col).mapInArrow(count, "chunk int, kind int, piece binary").repartition(CHUNKS, "chunk")
    out = np.zeros(1 << bits, np.uint8)
    for chunk, classes in pieces.mapInArrow(add, "chunk int, classes binary").collect():
        out[chunk * part : (chunk + 1) * part] = np.frombuffer(classes, np.uint8)
    return out


def _sets(docs: DataFrame, words: int, share: int, classes) -> DataFrame:
    """Of each document its set's size, a 128-bit fingerprint, and the prefix: its rarest n-grams, as many as a partner over the threshold can't all miss."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        rare = classes.value
        shift = np.uint64(64 - (len(rare).bit_length() - 1))
        for b in batches:
            for at in range(0, b.num_rows, 500):
                sizes, one, two, prefixes = [], [], [], []
                for t in b.column(1).slice(at, 500).to_pylist():
                    s = shingles(t, words)
                    n = len(s)
                    p = n - least_common(n, share) + 1 if n else 0
                    order = np.lexsort((s, rare[(s >> shift).astype(np.int64)]))[:p]
                    prefixes.append(s[order].view(np.int64))
                    whole = xxhash.xxh3_128_digest(s.tobytes())
                    sizes.append(n)
                    one.append(int.from_bytes(whole[:8], "little", signed=True))
                    two.append(int.from_bytes(whole[8:], "little", signed=True))
                ends = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
                flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 500), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["id", "n", "one", "two", "prefix"])

    return docs.select("id", "text").mapInArrow(run, f"id {kind_of(docs, 'id')}, n long, one long, two long, prefix array<long>")


def _bits(ids: DataFrame, words: int = 1 << 16) -> DataFrame:
    """A bitmap over hashes of ids: at most ``words`` rows of 64 bits, whatever the input."""
    h = F.xxhash64("id")
    return ids.groupBy(F.pmod(F.shiftright(h, 6), F.lit(words)).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(xxhash64(id) & 63 as int))")).alias("_set"))


def _verified(pairs: DataFrame, docs: DataFrame, words: int, share: int) -> DataFrame:
    """Of pairs (u, v) of ids those whose texts are over the threshold.

    Only texts that a pair asks for are shuffled: a bitmap of fixed size, so
    broadcast, sorts out most others, and a join the rest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        last, known = None, None
        for b in batches:
            keep = []
            for at in range(b.num_rows):
                v = b.column(1)[at].as_py()
                text = b.column(3)[at].as_py()
                if last is None or last != (v, text):
                    last, known = (v, text), shingles(text, words)
                keep.append(similar(shingles(b.column(2)[at].as_py(), words), known, share))
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    asked = pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))).distinct()
    words_of = F.pmod(F.shiftright(F.xxhash64("id"), 6), F.lit(1 << 16))
    bits = _bits(asked)
    texts = docs.select("id", "text").withColumn("_w", words_of).join(F.broadcast(bits), F.col("_w") == F.col("_word")).where(F.expr("(shiftright(_set, cast(xxhash64(id) & 63 as int)) & 1) = 1")).select("id", "text")
    left, right = texts.withColumnsRenamed({"id": "u", "text": "a"}), texts.withColumnsRenamed({"id": "v", "text": "b"})
    both = pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b")
    kind = kind_of(docs, "id")
    return both.mapInArrow(run, f"u {kind}, v {kind}").distinct()


def _length_and_place(x: str, y: str, share: int):
    """The length and positional filters for postings x and y (n: set size, pos: place in the prefix) of one n-gram, as a condition."""
    n, m, i, j = F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.pos"), F.col(f"{y}.pos")
    length = 100 * F.least(n, m) >= share * F.greatest(n, m)
    need = F.ceil(share * (n + m) / (100 + share) - 1e-9)  # rounding errs to the side of more pairs
    return length & (1 + F.least(n - i - 1, m - j - 1) >= need)


def _in_index_prefix(n, pos, share: int):
    """Whether a posting lies in the shorter prefix that is enough for the smaller set of a pair."""
    return pos <= n - F.ceil(2 * share * n / (100 + share) - 1e-9)


def _led(rows: DataFrame, lead: DataFrame, share: int) -> DataFrame:
    """Pairs of each posting with the leader of its n-gram."""
    x, y = rows.alias("x"), lead.alias("y")
    n, m, i, j = F.col("x.n"), F.col("y.n"), F.col("x.pos"), F.col("y.pos")
    within = F.when(n <= m, _in_index_prefix(n, i, share)) | F.when(m <= n, _in_index_prefix(m, j, share))
    apart = (F.col("x.id") != F.col("y.id")) & (F.col("x.part") != F.col("y.part"))
    return x.join(y, (F.col("x.gram") == F.col("y.gram")) & apart & _length_and_place("x", "y", share) & F.coalesce(within, F.lit(False)))


def _all_close(rows: DataFrame, share: int) -> DataFrame:
    """Pairs of all postings of an n-gram that can belong to similar sets.

    Of each pair the smaller set stands on the left, with its index prefix
    alone, so an n-gram that many sets have far from their rare end gives no
    pairs at all. Sets meet by n-gram and band of size: a partner is at most
    one band larger.
    """
    if share < 100:
        width = F.lit(1 / math.log(100 / share))
        scale = F.log(F.col("n")) * width
        bands = F.sequence(F.floor(scale), F.floor(scale + 1 + 1e-9))
    else:
        scale, bands = F.col("n"), F.array("n")
    small = rows.where(_in_index_prefix(F.col("n"), F.col("pos"), share)).withColumn("band", F.explode(bands))
    x, y = small.alias("x"), rows.withColumn("band", F.floor(scale)).alias("y")
    order = (F.col("x.n") < F.col("y.n")) | (F.col("x.n") == F.col("y.n")) & (F.col("x.id") < F.col("y.id"))
    met = (F.col("x.gram") == F.col("y.gram")) & (F.col("x.band") == F.col("y.band"))
    return x.join(y, met & order & (F.col("x.part") != F.col("y.part")) & _length_and_place("x", "y", share))


def link_components(docs: DataFrame, words: int = 5, share: int = 80, id_col: str = "doc_id", text_col: str = "text", bits: int = 20) -> DataFrame:
    """A row for each row of docs: its id, n_shingles (its set's size) and component_id (the smallest id reached by links, itself included).

    Two documents link when 100 * intersection >= share * union of their sets
    of ``words``-word n-grams. Texts with fewer words are one n-gram of all
    their words; null, empty and wordless texts have none and link with
    nothing. Ids are of any type that has an order. Null ids link with nothing
    and have a null component. Rows that share an id count as one document.
    A very long text is taken whole: its set and the texts of the pairs that
    it may belong to are in one task's memory at a time. Empty tables give no
    rows; other columns are not looked at and not carried.

    The result is written to the shared folder; all that led to it is dropped.
    """
    spark = docs.sparkSession
    tables = Scratch(spark)
    written = tables.written
    docs = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    classes = spark.sparkContext.broadcast(frequency_classes(docs, words, bits))
    sets = written(_sets(docs, words, share, classes), "sets")
    # one class for each set, under its smallest id; empty sets and null ids stand alone
    reps = sets.where("n > 0 and id is not null").groupBy("one", "two", "n").agg(F.min("id").alias("rep"))
    members = reps.withColumnsRenamed({"one": "_one", "two": "_two", "n": "_n"})
    same_set = (F.col("one") == F.col("_one")) & (F.col("two") == F.col("_two"))
    known = sets.join(members, (F.col("id") == F.col("rep")) & same_set, "left_semi").dropDuplicates(["id", "one", "two"])
    postings = known.select("id", "n", F.posexplode("prefix").alias("pos", "gram"))
    shared = postings.groupBy("gram").agg(F.min("id").alias("_lo"), F.max("id").alias("_hi")).where("_lo <> _hi").select("gram")
    # an n-gram that very many hold is split in the joins, here and below
    postings = written(postings.join(dealt_anew(shared, "gram"), "gram").select("gram", "id", "n", "pos"), "postings")
    # the prefixes are in the postings now
    sets = written(sets.select("id", "n", "one", "two"), "sizes")
    reps = sets.where("n > 0 and id is not null").groupBy("one", "two", "n").agg(F.min("id").alias("rep"))
    members = reps.withColumnsRenamed({"one": "_one", "two": "_two", "n": "_n"})
    kept = [postings, sets]
    tables.drop(*kept)
    links, tried, label = None, None, None
    for turn in range(3):
        # what is still apart: n-grams whose classes lie in more than one component
        if label is None:
            rows = postings.withColumn("part", F.col("id"))
        else:
            part = F.coalesce("component", "id").alias("part")
            rows = postings.join(label, F.col("id") == F.col("node"), "left").select("gram", "id", "n", "pos", part)
            apart = rows.groupBy("gram").agg(F.min("part").alias("_lo"), F.max("part").alias("_hi")).where("_lo <> _hi").select("gram")
            rows = written(rows.join(dealt_anew(apart, "gram"), "gram"), "apart")
        if turn < 2:
            # the leader: first the one with the fewest rarer n-grams, then any
            first = F.col("pos") if turn == 0 else F.xxhash64("id")
            lead = rows.groupBy("gram").agg(F.min(F.struct(first.alias("first"), "id", "n", "pos", "part")).alias("_lead"))
            pairs = _led(rows, dealt_anew(lead.select("gram", "_lead.*"), "gram"), share)
        else:
            pairs = _all_close(rows, share)
        # the smaller id second, so that texts of leaders meet many partners in a row
        pairs = pairs.select(F.greatest("x.id", "y.id").alias("u"), F.least("x.id", "y.id").alias("v")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["u", "v"], "left_anti")
        pairs = written(pairs, "pairs")
        if pairs.isEmpty():
            continue
        found = written(_verified(pairs, docs, words, share), "links")
        kept += [pairs, found]
        tables.drop(*kept)
        links = found if links is None else links.unionByName(found)
        tried = pairs if tried is None else tried.unionByName(pairs)
        label = components(links)
    if label is None:
        whole = members.select("_one", "_two", "_n", F.col("rep").alias("component"))
    else:
        whole = members.join(label, F.col("rep") == F.col("node"), "left").select("_one", "_two", "_n", F.coalesce("component", "rep").alias("component"))
    out = sets.select("id", "n", "one", "two").join(whole, same_set & (F.col("n") == F.col("_n")) & F.col("id").isNotNull(), "left")
    component = F.coalesce("component", "id").alias("component_id")
    out = tables.keep(out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component), "components")
    classes.unpersist()
    return out


def drop_near_copies(docs: DataFrame, words: int = 5, share: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that aren't the first of their component: one document of each group stays, with all its columns, whatever their names. Rows with null ids stay; of rows that share an id and stay, all stay."""
    (name,) = fresh(docs, "_gone")
    parts = link_components(docs, words, share, id_col, text_col)
    gone = parts.where(F.col(quoted(id_col)) != F.col("component_id")).select(F.col(quoted(id_col)).alias(name)).distinct()
    return docs.join(gone, F.col(quoted(id_col)) == F.col(name), "left_anti")
