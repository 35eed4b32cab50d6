"""Tables between the steps of an operator: written once to the session's shared folder, read from there, dropped after use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's shared checkpoint folder, set from spark.checkpoint.dir if it isn't yet.

    Where that is unset, a session on this machine alone gets a temporary
    folder; on a cluster, whose machines could not see it, it is an error.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            folder = tempfile.mkdtemp(prefix="pulseframe-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; what is there goes when the driver ends, if not before."""
    path = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    fs, place = _file_system(spark, path)
    fs.mkdirs(place.getParent())
    fs.create(place).close()  # only a path that is there is remembered
    fs.deleteOnExit(place)
    fs.delete(place, True)
    return path


def discard(spark: SparkSession, *paths: str) -> None:
    """Drops what no plan reads any more."""
    for path in paths:
        fs, place = _file_system(spark, path)
        fs.delete(place, True)


class Scratch:
    """The tables that one call of an operator writes, to be dropped together once its result is written.

    ``keep`` writes a result that outlives the others.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self._made = spark, []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """The rows of df, written once and read from there. Their layout is forgotten, so a later join deals both sides anew and can split what is skewed."""
        out, path = _written(df, name)
        self._made.append((out, path))
        return out

    def drop(self, *but: DataFrame) -> None:
        """Drops all that was written, but for the given tables."""
        kept = [m for m in self._made if any(m[0] is df for df in but)]
        discard(self.spark, *(m[1] for m in self._made if not any(m is k for k in kept)))
        self._made = kept

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """df, written; everything else is dropped."""
        out = _written(df, name)[0]
        self.drop()
        return out


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once to the shared folder and read from there."""
    return _written(df, name)[0]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have, made of the given ones."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    """A column's name as a reference to it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def dealt_anew(df: DataFrame, *keys: str) -> DataFrame:
    """df, whose layout by the keys the planner no longer knows.

    What an aggregate gives lies as it was aggregated, and joined with its own
    rows it would keep them there: then a key that very many rows share is one
    task. With both sides dealt for the join alone, Spark can split such a key.
    """
    return df.withColumns({k: F.element_at(F.array(k), 1) for k in keys})
