"""Mixing sources to target weights by Pareto order sampling.

Each source has a target in words. A document first gets its certain whole
copies; what is missing to the target is a fixed-size sample, drawn by ranking
the documents by their random odds over their inclusion odds and taking them
in that order until the words are full.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.llm.common import WORD, Scratch, fresh, quoted

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)


def uniform(c: Column, salt: str) -> Column:
    """A number in (0, 1) that depends on c and the salt alone."""
    digits = F.substring(F.md5(F.concat(F.coalesce(c.cast("string"), F.lit("")), F.lit(salt))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / 281474976710656.0


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """One row for each source of sizes (_source, _size): source_size, target.

    The sources share the whole size by weight; none gets over ``most`` times
    its own size, and what it can't take goes to the others by weight. That
    is min(most * size, weight * level) at the one level where all is dealt.
    The table has one row per source, so its windows are small.
    """
    per = sizes.groupBy("_source").agg(F.coalesce(F.sum("_size"), F.lit(0)).cast("long").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    per = per.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("long"))
    # in order of size over weight, the capped sources come first
    order = Window.orderBy(F.col("source_size") / F.col("_w"), "source_size", F.col("_source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    per = per.withColumns({
        "_total": F.sum("source_size").over(everything), "_weight": F.sum("_w").over(everything),
        "_s": F.coalesce(F.sum("source_size").over(before), F.lit(0)), "_v": F.coalesce(F.sum("_w").over(before), F.lit(0)),
    })
    # a source is capped if its share of what the earlier ones leave is over its cap
    per = per.withColumn("_capped", (F.col("_total") - most * F.col("_s")) * F.col("_w") >= most * F.col("source_size") * (F.col("_weight") - F.col("_v")))
    left = F.col("_total") - F.coalesce(F.sum(F.when(F.col("_capped"), F.lit(most) * F.col("source_size"))).over(everything), F.lit(0))
    open_weight = F.sum(F.when(~F.col("_capped"), F.col("_w"))).over(everything)
    target = F.when(F.col("_capped"), (F.lit(most) * F.col("source_size")).cast("double")).otherwise((left * F.col("_w")).cast("double") / open_weight.cast("double"))
    return per.select("_source", "source_size", target.alias("target"))


def copy_means(slim: DataFrame, per: DataFrame, most: int) -> DataFrame:
    """Of each source and class of weight: mean, the copies that a document is to get on average.

    A document's mean is its weight times its source's level, at most
    ``most``; the level is the one at which sizes times means make the target.
    Heavier classes reach the bound first, so the level follows from running
    sums over the classes, of which a source has few.
    """
    by = slim.groupBy("_source", "_weight").agg(F.sum("_size").cast("double").alias("_words"))
    by = by.join(per.select(F.col("_source").alias("_ps"), "target"), F.col("_source").eqNullSafe(F.col("_ps"))).drop("_ps")
    of = Window.partitionBy("_source")
    heavier = of.orderBy(F.col("_weight").desc()).rowsBetween(Window.unboundedPreceding, -1)
    onwards = of.orderBy(F.col("_weight").desc()).rowsBetween(0, Window.unboundedFollowing)
    by = by.withColumns({
        "_before": F.coalesce(F.sum("_words").over(heavier), F.lit(0.0)),
        "_pull": F.sum(F.col("_words") * F.col("_weight")).over(onwards),
    })
    over = (F.col("target") - most * F.col("_before")) * F.col("_weight") >= most * F.col("_pull")
    by = by.withColumn("_full", over & (F.col("_weight") > 0))
    bound = F.coalesce(F.sum(F.when(F.col("_full"), F.col("_words"))).over(of), F.lit(0.0))
    pull = F.sum(F.when(~F.col("_full"), F.col("_words") * F.col("_weight"))).over(of)
    by = by.withColumn("_level", F.when(pull > 0, (F.col("target") - most * bound) / pull).otherwise(F.lit(0.0)))
    mean = F.when(F.col("_full"), F.lit(float(most))).otherwise(F.least(F.col("_level") * F.col("_weight"), F.lit(float(most))))
    return by.select(F.col("_source").alias("_ms"), F.col("_weight").alias("_mw"), mean.alias("_mean"))


def octave(weight: Column) -> Column:
    """A weight rounded to an eighth of an octave, so that a source has few different ones; null, negative and non-finite ones are 0."""
    sound = weight.isNotNull() & (weight > 0) & (weight < float("inf"))
    return F.when(sound, F.pow(F.lit(2.0), F.round(F.log2(weight) * 8) / 8)).otherwise(F.lit(0.0))


def plan_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight: Column | None = None,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = 3,
    salt: str = "mix",
    cells: int = 4096,
) -> DataFrame:
    """What the mix takes of each row of docs, without the texts.

    Columns: doc_id, source, of (the text's hash), row (1.. among wholly
    alike rows), size, source_size, target, copies (how often the mix takes
    it) and taken (copies times size).

    ``weight``: a document's relative weight within its source, over the
    columns of docs, taken to an eighth of an octave; by default all are
    alike. A document's mean copies are its weight times its source's level,
    at most ``most``. Whole copies are certain; the rest of the mean is its
    inclusion probability p. With u uniform by id, documents are ranked by
    (u/(1-u)) / (p/(1-p)), and taken in that order while half of the next one
    still fits the words that are missing; then one more document, the one
    whose size comes nearest to the gap, if any comes nearer than none.

    The running sums are made in ``cells`` ranges of the rank within each
    source, so no task holds a whole source.

    Nulls and ends: a null text has size 0, a null source is a source of its
    own and comes last, null ids draw by their text and rows that tie are
    ranked by size, then by the text's hash; wholly equal rows are
    interchangeable. Null or negative weights count as 0, and such documents
    are never taken. A very long text counts its words where it is read. An
    empty table gives an empty table. Other columns of docs aren't looked at.
    """
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    heavy = F.lit(1.0) if weight is None else octave(weight.cast("double"))
    slim = docs.select(
        F.col(quoted(id_col)).alias("_id"), F.col(quoted(source_col)).alias("_source"), size.alias("_size"),
        F.xxhash64(F.col(quoted(text_col))).alias("_of"), heavy.alias("_weight"),
    )
    # from here on no text: rows that are alike in all these are one row with a count
    slim = slim.groupBy("_id", "_source", "_size", "_of", "_weight").agg(F.count("*").alias("_rows"))
    slim = slim.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int")))).drop("_rows")
    # what is read more than once is written, here and below: a few numbers a document
    written = Scratch(docs.sparkSession).written
    slim = written(slim, "sizes")
    per = written(source_targets(slim, weights, most), "targets")
    means = written(copy_means(slim, per, most), "means")
    per = per.withColumnRenamed("_source", "_of_source")
    rows = slim.join(per, F.col("_source").eqNullSafe(F.col("_of_source"))).drop("_of_source")
    rows = rows.join(means, F.col("_source").eqNullSafe(F.col("_ms")) & (F.col("_weight") == F.col("_mw"))).drop("_ms", "_mw")
    u = uniform(F.coalesce(F.col("_id").cast("string"), F.col("_of").cast("string")), salt)
    rows = rows.withColumn("_whole", F.floor("_mean").cast("long")).withColumn("_p", F.col("_mean") - F.col("_whole"))
    odds = (u / (1.0 - u)) / (F.col("_p") / (1.0 - F.col("_p")))
    rows = rows.withColumn("_q", F.when((F.col("_p") > 0) & (F.col("_size") > 0), odds))
    rows = rows.withColumn("_cell", F.floor(F.col("_q") / (1.0 + F.col("_q")) * cells).cast("int"))
    rows = written(rows.select("_id", "_source", "_size", "_of", "_row", "source_size", "target", "_whole", "_q", "_cell"), "ranks")
    # words of each range of ranks, then of all ranges before it
    drawn = F.when(F.col("_q").isNotNull(), F.col("_size")).otherwise(0)
    cell = rows.groupBy("_source", "_cell").agg(F.sum(drawn).alias("_words"), F.sum(F.col("_size") * F.col("_whole")).alias("_sure"))
    of = Window.partitionBy("_source")
    before = of.orderBy(F.col("_cell").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    cell = cell.withColumns({"_start": F.coalesce(F.sum("_words").over(before), F.lit(0)), "_sure": F.sum("_sure").over(of)})
    cell = cell.select(F.col("_source").alias("_cs"), F.col("_cell").alias("_cc"), "_start", "_sure")
    # rows without a draw need no place in it, and would all meet in one cell
    sampled = rows.where("_q is not null").join(cell, F.col("_source").eqNullSafe(F.col("_cs")) & (F.col("_cell") == F.col("_cc"))).drop("_cs", "_cc")
    order = Window.partitionBy("_source", "_cell").orderBy("_q", "_size", "_of", "_id", "_row")
    upto = F.col("_start") + F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    sampled = sampled.withColumn("_end", upto)
    rest = F.col("target") - F.col("_sure")
    sampled = written(sampled.withColumn("_in", F.col("_end") - F.col("_size") / 2.0 <= rest).withColumn("_rest", rest), "drawn")
    # the one document that comes nearest to closing the gap
    got = F.coalesce(F.sum(F.when(F.col("_in"), F.col("_size"))), F.lit(0))
    gap = sampled.groupBy("_source").agg(F.first("_rest").alias("_rest"), got.alias("_got"))
    gap = gap.select(F.col("_source").alias("_gs"), (F.col("_rest") - F.col("_got")).alias("_gap"))
    sampled = sampled.join(gap, F.col("_source").eqNullSafe(F.col("_gs"))).drop("_gs")
    near = F.struct(F.abs(F.col("_gap") - F.col("_size")).alias("d"), "_q", "_size", "_of", "_id", "_row")
    nearer = F.abs(F.col("_gap") - F.col("_size")) < F.abs("_gap")
    close = sampled.where(~F.col("_in") & nearer).groupBy("_source").agg(F.min(near).alias("_near"))
    close = close.select(F.col("_source").alias("_ns"), F.col("_near").alias("_near"))
    sampled = sampled.join(close, F.col("_source").eqNullSafe(F.col("_ns")), "left")
    same = [F.col(f"_near.{c}").eqNullSafe(F.col(c)) for c in ("_id", "_of", "_row", "_size")]
    closing = ~F.col("_in") & F.col("_near").isNotNull() & reduce(lambda a, b: a & b, same)
    slim_cols = ["_id", "_source", "_size", "_of", "_row", "source_size", "target"]
    taken = sampled.select(*slim_cols, (F.col("_whole") + F.when(F.col("_in") | closing, 1).otherwise(0)).alias("copies"))
    taken = taken.unionByName(rows.where("_q is null").select(*slim_cols, F.col("_whole").alias("copies")))
    names = {"_id": "doc_id", "_source": "source", "_of": "of", "_row": "row", "_size": "size"}
    taken = taken.withColumnsRenamed(names).withColumn("copies", F.col("copies").cast("long"))
    return taken.withColumn("taken", F.col("copies") * F.col("size"))


def _row_keys(id_: Column, source: Column, of: Column) -> tuple[Column, Column]:
    """128 bits of what makes rows alike; nulls count as values of their own."""
    parts = (id_, id_.isNull(), source, source.isNull(), of)
    return F.xxhash64(*parts), F.xxhash64(F.lit(7), *parts)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """The mixed corpus: each row of docs as often as ``plan_mix`` takes it, so not at all or up to three times; columns as in docs, whatever their names.

    Nulls, ties, repeated rows and empty tables are as in ``plan_mix``; texts
    are shuffled once, by their row's keys. Rows that are alike in id, text
    and source are numbered in one task, so a table of nothing but copies of
    one row has no better plan.
    """
    plan = plan_mix(docs, id_col, text_col, source_col, **kw).where("copies > 0")
    a, b, r, n, a2, b2, copies = fresh(docs, "_a", "_b", "_r", "_n", "_a2", "_b2", "_copies")
    one, two = _row_keys(F.col("doc_id"), F.col("source"), F.col("of"))
    plan = plan.groupBy(one.alias(a2), two.alias(b2)).agg(F.map_from_entries(F.collect_list(F.struct("row", "copies"))).alias(copies))
    one, two = _row_keys(F.col(quoted(id_col)), F.col(quoted(source_col)), F.xxhash64(F.col(quoted(text_col))))
    rows = docs.withColumns({a: one, b: two})
    rows = rows.withColumn(r, F.row_number().over(Window.partitionBy(a, b).orderBy(F.lit(1))))
    rows = rows.join(plan, (F.col(a) == F.col(a2)) & (F.col(b) == F.col(b2))).withColumn(n, F.element_at(copies, F.col(r))).where(F.col(n) > 0)
    rows = rows.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))))
    return rows.select(*map(quoted, docs.columns))
