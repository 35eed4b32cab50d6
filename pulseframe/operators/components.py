"""Connected components of a table of edges, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.operators.scratch import Scratch, checkpoint_folder, dealt_anew

__all__ = ["checkpoint_folder", "components"]


def _nearest(edges: DataFrame) -> DataFrame:
    """Of each u the smallest v."""
    return dealt_anew(edges.groupBy("u").agg(F.min("v").alias("m")), "u")


MANY, DENSE = 1_000_000, 4


def components(edges: DataFrame, stored: bool = False) -> DataFrame:
    """Of edges (u, v): rows (node, component), the component being its smallest node. Nodes are of any type that has an order.

    Alternating large-star and small-star steps until nothing changes. The
    edges of each round are written to the shared folder, so a lost executor
    costs one round; the rounds before the last are dropped. A node that very
    many edges meet in is aggregated in parts and split in the joins.

    Of many edges among much fewer nodes, those to each node's smallest and
    largest neighbours are taken first; then all edges are looked at once, and
    what still joins two components is treated alike, as edges between these.

    Edges with a null end, and those from a node to itself, are left out;
    nodes without edges have no row. Repeated edges count once. An empty
    table gives an empty table. With ``stored`` the edges are read as they
    lie, since they are a table already; else they are written first.
    """
    tables = Scratch(edges.sparkSession)
    pairs = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    if not stored:
        pairs = tables.written(pairs.distinct(), "edges")
    n = pairs.count()
    if n >= MANY:
        ends = [pairs.groupBy(F.col(x).alias("u")).agg(F.min(y).alias("a"), F.max(y).alias("b")) for x, y in ("uv", "vu")]
        ends = tables.written(ends[0].unionByName(ends[1]), "ends")
        if n > DENSE * ends.count():
            return _by_sample(pairs, ends.select("u", F.explode(F.array("a", "b")).alias("v")), tables)
    return _by_stars(pairs, tables)


def _by_sample(pairs: DataFrame, sample: DataFrame, tables: Scratch) -> DataFrame:
    """The components of pairs, found of a sample of them and then joined by what it left out."""
    found = components(sample)
    # of u the components that it has a neighbour in are few, so the second join is of few rows
    near = pairs.join(found.select(F.col("node").alias("v"), F.col("component").alias("b")), "v").select("u", "b").distinct()
    rest = near.join(found.select(F.col("node").alias("u"), F.col("component").alias("a")), "u").where("a <> b")
    rest = tables.written(rest.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "rest")
    if rest.isEmpty():
        tables.drop()
        return found
    over = components(rest, stored=True).select(F.col("node").alias("component"), F.col("component").alias("over"))
    return tables.keep(found.join(over, "component", "left").select("node", F.coalesce("over", "component").alias("component")), "components")


def _by_stars(edges: DataFrame, tables: Scratch) -> DataFrame:
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _nearest(both).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = _nearest(large)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = tables.written(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        tables.drop(edges)
        if now == state:
            # settled edges are stars: each node points to the smallest of its component
            stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
        state = now
