"""Embedding near-dedup by Euclidean p-stable hashing.

Normalised vectors are projected on random normal directions, shifted and cut
into steps; a few steps together are a bucket of one table, and several tables
make it likely that near vectors share a bucket. Pairs in a bucket whose sign
sketches are near enough are checked by their exact cosine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.common import Scratch, components, kind_of, quoted

SKETCH = 128


def collision(distance: float, width: float) -> float:
    """The chance that one projection puts two points at that distance into one step of that width."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan_tables(n: int, threshold: float, width: float, miss: float) -> tuple[int, int]:
    """(projections a table, tables): so many projections that unrelated vectors seldom meet among n, so many tables that a pair at the threshold is missed with a chance of ``miss``."""
    near, far = collision(math.sqrt(2 - 2 * threshold), width), collision(math.sqrt(2), width)
    k = max(1, round(math.log(max(n, 2)) / -math.log(far)) - 3)
    return k, max(1, math.ceil(math.log(miss) / math.log(1 - near**k)))


def sketch_limit(threshold: float) -> int:
    """Sign bits that may differ: six deviations over what a pair at the threshold differs by."""
    p = math.acos(threshold) / math.pi
    return math.ceil(SKETCH * p + 6 * math.sqrt(SKETCH * p * (1 - p)))


def _matrices(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By length: which rows of a column of lists, and their numbers, scaled so that squares neither vanish nor overflow."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        x = values[offsets[at][:, None] + np.arange(d)].astype(float)
        yield at, x / np.abs(x).max(1)[:, None]


def _hash(vectors: DataFrame, k: int, tables: int, width: float, seed: int) -> DataFrame:
    """(id, vec) to id, s1, s2 (sign sketch) and buckets, one of each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        mix = np.random.default_rng(seed).integers(1, 2**62, k, dtype=np.int64) * 2 + 1
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                b = whole.slice(start, 2000)
                s, buckets = np.zeros((b.num_rows, 2), np.int64), np.zeros((b.num_rows, tables), np.int64)
                for at, x in _matrices(b.column(1)):
                    d = x.shape[1]
                    x /= np.sqrt((x * x).sum(1))[:, None]
                    if d not in made:
                        random = np.random.default_rng([seed, d])
                        normal, shift = random.normal(size=(d, tables * k)), random.uniform(0, width, tables * k)
                        made[d] = normal, shift, random.normal(size=(d, SKETCH))
                    a, shift, signs = made[d]
                    s[at] = np.packbits(x @ signs > 0, axis=1).view(np.int64)
                    with np.errstate(over="ignore"):
                        steps = np.floor((x @ a + shift) / width).astype(np.int64).reshape(len(at), tables, k)
                        buckets[at] = (steps * mix).sum(2) * 31 + d
                ends = np.arange(b.num_rows + 1, dtype=np.int32) * tables
                flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(buckets.ravel()))
                columns = [b.column(0), pa.array(s[:, 0].copy()), pa.array(s[:, 1].copy()), flat]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "s1", "s2", "buckets"])

    return vectors.select("id", "vec").mapInArrow(run, f"id {kind_of(vectors, 'id')}, s1 long, s2 long, buckets array<long>")


def _cosines(pairs: DataFrame, threshold: float) -> DataFrame:
    """(u, v, a, b) to the u, v whose vectors a and b have a cosine of at least the threshold, in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                p = whole.slice(start, 2000)
                keep = np.zeros(p.num_rows, bool)
                other = {x.shape[1]: (at, x) for at, x in _matrices(p.column(3))}
                for at, x in _matrices(p.column(2)):
                    there, y = other.get(x.shape[1], (at[:0], x[:0]))
                    both, i, j = np.intersect1d(at, there, assume_unique=True, return_indices=True)
                    x, y = x[i], y[j]
                    dot = lambda a, b: np.einsum("ij,ij->i", a, b)
                    keep[both] = dot(x, y) / np.sqrt(dot(x, x) * dot(y, y)) >= threshold
                yield p.select(["u", "v"]).filter(pa.array(keep))

    kind = kind_of(pairs, "u")
    return pairs.mapInArrow(run, f"u {kind}, v {kind}")


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    threshold: float = 0.9,
    width: float = 2.0,
    miss: float = 0.05,
    seed: int = 7,
) -> DataFrame:
    """A row for each row of vectors: its id, n_links (other rows with a cosine of at least the threshold), component_id (the smallest id reachable by links), kept (whether that is its own).

    ``miss`` bounds the chance to miss a pair just at the threshold; nearer
    pairs are missed less, pairs below it are never linked. Equal vectors are
    one class with a count, so their pairs are never made.

    Vectors that are null or zero or hold null or non-finite numbers link with
    nothing, and so do vectors of different lengths. Rows that repeat an id
    are separate rows with that id; ids are of any type that has an order.
    Null ids link with nothing and stay null in both columns, with kept false.
    Empty tables give no rows; other columns are not carried.

    The result is written to the shared folder; all that led to it is dropped.
    """
    tables = Scratch(vectors.sparkSession)
    vec = F.col(quoted(vec_col)).cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    sound = F.col(quoted(vec_col)).isNotNull() & F.col(quoted(id_col)).isNotNull() & F.coalesce(finite, F.lit(False))
    hashes = F.when(sound, F.xxhash64(vec)).alias("_a"), F.when(sound, F.xxhash64(F.lit(7), vec)).alias("_b")
    rows = vectors.select(F.col(quoted(id_col)).alias("_row"), sound.alias("_sound"), *hashes, vec.alias("vec"))
    classes = rows.where("_sound").groupBy("_a", "_b").agg(F.min("_row").alias("id"), F.count("*").alias("n"), F.first("vec").alias("vec"))
    classes = tables.written(classes, "classes")
    k, many = plan_tables(classes.count(), threshold, width, miss)
    hashed = _hash(classes, k, many, width, seed).select("id", "s1", "s2", F.posexplode("buckets").alias("t", "bucket"))
    left, right = hashed.alias("l"), hashed.alias("r")
    differ = F.bit_count(F.col("l.s1").bitwiseXOR(F.col("r.s1"))) + F.bit_count(F.col("l.s2").bitwiseXOR(F.col("r.s2")))
    met = (F.col("l.t") == F.col("r.t")) & (F.col("l.bucket") == F.col("r.bucket")) & (F.col("l.id") < F.col("r.id"))
    pairs = left.join(right, met & (differ <= sketch_limit(threshold)))
    pairs = pairs.select(F.col("l.id").alias("u"), F.col("r.id").alias("v")).distinct()
    a, b = classes.select(F.col("id").alias("u"), F.col("vec").alias("a")), classes.select(F.col("id").alias("v"), F.col("vec").alias("b"))
    links = tables.written(_cosines(pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b"), threshold), "links")
    count = classes.select(F.col("id").alias("v"), "n")
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = both.join(count, "v").groupBy(F.col("u").alias("_u")).agg(F.sum("n").alias("_linked"))
    parts = components(links).withColumnsRenamed({"node": "_node", "component": "_component"})
    info = classes.select("_a", "_b", "id", "n").join(linked, F.col("id") == F.col("_u"), "left").join(parts, F.col("id") == F.col("_node"), "left")
    others = F.col("n") - 1 + F.coalesce("_linked", F.lit(0))
    info = info.select("_a", "_b", others.alias("_links"), F.coalesce("_component", "id").alias("_component"))
    out = rows.select("_row", "_a", "_b").join(tables.written(info, "classes-linked"), ["_a", "_b"], "left")
    component = F.coalesce("_component", "_row")
    own = F.coalesce(component == F.col("_row"), F.lit(False)).alias("kept")
    n_links = F.coalesce("_links", F.lit(0)).cast("long").alias("n_links")
    return tables.keep(out.select(F.col("_row").alias(id_col), n_links, component.alias("component_id"), own), "near-duplicates")
