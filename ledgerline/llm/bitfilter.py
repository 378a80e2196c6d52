"""A filter of bounded size over a set of 64-bit keys, broadcast instead of the keys.

The filter has 2**log2_bits bits in words of 64; a key sets one bit. ``bits_for``
gives about 16 bits a key, up to a bound that no input changes, so it may be
broadcast. It never misses a key; it lets others pass: about one in 16 within the
bound, more beyond it, which costs time alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

#: From 2**16 bits to 2**26, which are at most 1,048,576 rows of two longs (about 50 MB with their table).
LEAST, MOST = 16, 26


def bits_for(keys: int) -> int:
    """log2 of the filter's bits for a number of keys."""
    return min(MOST, max(LEAST, (16 * keys).bit_length()))


def _place(key: Column, log2_bits: int) -> Column:
    return key.bitwiseAND(F.lit((1 << log2_bits) - 1))


def build(keys: DataFrame, key: str, log2_bits: int) -> DataFrame:
    """(word, bits) of every word in which a key of ``keys`` has set a bit."""
    at = _place(F.col(key), log2_bits)
    words = keys.where(F.col(key).isNotNull()).select(F.shiftright(at, 6).alias("word"), at.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    return words.groupBy("word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bits"))


def flagged(df: DataFrame, key: Column, table: DataFrame, into: str, log2_bits: int) -> DataFrame:
    """``df`` with the boolean ``into``: false where ``key`` is surely none of the filter's keys."""
    at = _place(key, log2_bits)
    probe = df.withColumn("__word", F.shiftright(at, 6)).withColumn("__bit", at.bitwiseAND(F.lit(63)).cast("int"))
    found = probe.join(F.broadcast(table.select(F.col("word").alias("__word"), F.col("bits").alias("__bits"))), "__word", "left")
    hit = F.call_function("shiftrightunsigned", F.col("__bits"), F.col("__bit")).bitwiseAND(F.lit(1)) == 1
    return found.withColumn(into, F.coalesce(hit, F.lit(False))).drop("__word", "__bit", "__bits")


def narrowed(df: DataFrame, key: Column, keys: DataFrame, label: str) -> DataFrame:
    """The rows of ``df`` whose ``key`` may be in ``keys`` (one long column, stored); none that is goes, and none moves."""
    log2_bits = bits_for(keys.count())
    table = stash(build(keys, keys.columns[0], log2_bits), label)
    return flagged(df, key, table, "__may", log2_bits).where("__may").drop("__may")
