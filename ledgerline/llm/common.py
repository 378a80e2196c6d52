"""Shared helpers: staging tables in the shared folder, and safe column names."""

from __future__ import annotations

import ctypes
import gc
import time

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import staging_path, stash  # noqa: F401  (the operators here take them from this module)

#: ASCII white space, the word separators of every word-based operator here.
WORD = r"[^\x20\x09-\x0D]+"


def trim_memory() -> None:
    """Give freed memory back to the system at the end of a Python task: workers stay, and share the executor's limit."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now: it does so when the driver's garbage is collected.

    A step that has just ended is let go by Spark's listeners a moment later, so this is done twice.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def documents(df: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null text: empty) with ``more`` columns, under exactly these names."""
    return df.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, whatever extra columns it carries."""
    name, taken = f"__{base}", {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(counted: DataFrame, n: str, into: str, block: int = 100_000) -> DataFrame:
    """Each row of ``counted`` as often as ``n`` says, numbered from 1 in ``into``, ``n`` dropped; no array is longer than a block."""
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(block).cast("long")))
    blocks = counted.withColumn(into, first)
    return blocks.withColumn(into, F.explode(F.sequence(F.col(into) + 1, F.least(F.col(into) + block, F.col(n))))).drop(n)


def utf8(column: Column) -> Column:
    return F.encode(column, "UTF-8")
