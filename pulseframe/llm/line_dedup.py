"""Line dedup: lines that many documents share stay in one document only.

Explode the normalised lines, hash them, count the distinct documents of each
hash, drop the lines of hashes over the threshold and reassemble the rest by
position. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.common import SPACES, ascii_lower, fresh, quoted, written


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with its text reassembled from the lines that stay, and n_lines, n_dropped after its own columns.

    A line's key is the line without white space at its ends and with A-Z in
    lower case. Keys of at least ``min_chars`` code points found in at least
    ``min_docs`` documents lose their lines, but for those in the document
    with the largest id.

    Nulls and ends: a null or empty text is one empty line, and stays null
    when null. A row with a null id loses no line and counts for none. Rows
    that repeat an id count as one document. Keys too short never drop. A
    document may end with an empty text; its row stays. A very long text, or
    one of very many lines, is split and reassembled as one row. An empty
    table gives an empty table. Columns of docs named n_lines or n_dropped are
    replaced; all others pass through, whatever their names.
    """
    docs = docs.drop("n_lines", "n_dropped")
    of, drop_id, drop_of, drop = fresh(docs, "_of", "_drop_id", "_drop_of", "_drop")
    id_, text = F.col(quoted(id_col)), F.col(quoted(text_col))
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    # the row is known again by its id and its text, since ids may repeat
    keyed = docs.select(id_.alias("_id"), F.xxhash64(text).alias("_of"), lines.alias("_lines")).where("_id is not null")
    keyed = keyed.select("_id", "_of", F.posexplode("_lines").alias("_at", "_line"))
    key = ascii_lower(F.trim(F.col("_line"), F.lit(SPACES)))
    keyed = keyed.where(F.char_length("_line") >= min_chars).select("_id", "_of", "_at", key.alias("_key")).where(F.char_length("_key") >= min_chars)
    # written, since it is read twice and is small beside the texts
    keyed = written(keyed.select("_id", "_of", "_at", F.xxhash64("_key").alias("_a"), F.xxhash64(F.lit(7), "_key").alias("_b")), "line-keys")
    # first by hash and document, so that a line of a third of all documents is counted in many tasks
    shared = keyed.groupBy("_a", "_b", "_id").agg(F.lit(1).alias("_one")).groupBy("_a", "_b").agg(F.count("*").alias("_n"), F.max("_id").alias("_keeper")).where(F.col("_n") >= min_docs)
    # written, so that both sides of the join are dealt for it alone and Spark can split a line that very many hold, or broadcast a table that proves small
    shared = written(shared.select("_a", "_b", "_keeper"), "shared-lines")
    drops = keyed.join(shared, ["_a", "_b"]).where("_id <> _keeper").groupBy("_id", "_of").agg(F.collect_set("_at").alias("_drop"))
    drops = drops.select(F.col("_id").alias(drop_id), F.col("_of").alias(drop_of), F.col("_drop").alias(drop))
    out = docs.withColumn(of, F.xxhash64(text)).join(drops, (id_ == F.col(drop_id)) & (F.col(of) == F.col(drop_of)), "left")
    kept = F.when(F.col(drop).isNull(), text).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(drop, i)), "\n"))
    n_lines = F.char_length(F.coalesce(text, F.lit(""))) - F.char_length(F.translate(F.coalesce(text, F.lit("")), "\n", "")) + 1
    out = out.withColumns({"n_lines": n_lines.cast("long"), "n_dropped": F.coalesce(F.size(drop), F.lit(0)).cast("long"), text_col: kept})
    return out.drop(of, drop_id, drop_of, drop)
