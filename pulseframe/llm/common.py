"""Helpers shared by the corpus operators: tables, scratch space, components."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.operators.components import components
from pulseframe.operators.scratch import Scratch, dealt_anew, fresh, quoted, scratch, written

__all__ = ["LOWER", "SPACES", "UPPER", "WORD", "Scratch", "ascii_lower", "components", "dealt_anew", "fresh", "give_back", "kind_of", "quoted", "scratch", "table", "written"]

#: The white space that separates words: space, \t, \n, \v, \f, \r.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kind_of(df: DataFrame, column: str) -> str:
    """A column's type, as a schema string has it."""
    return df.schema[column].dataType.simpleString()


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all else as it is. Texts of ASCII only take the faster built-in."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def give_back() -> None:
    """Gives the system what earlier tasks of this worker have freed; workers are used again and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
