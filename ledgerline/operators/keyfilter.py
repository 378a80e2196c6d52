"""What a folder of rows says of its keys: their range, and a Bloom filter in a small table beside them.

A filter has 16 to 32 bits a key, of which a key sets HASHES. It never misses one; of
other keys one in some thousands passes. It is rows of 64 bits, so filters are made,
kept and asked by joins, and no one machine holds them; on the driver there are a
range and a size for each folder. Few keys, as a merge or a batch brings, open few
folders beside their own; very many keys pass most filters, and then the folders'
keys are read as they would be without.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of a filter's bits, at least and at most; a folder of more keys than fit has a weaker filter.
LEAST, MOST = 10, 34
HASHES = 7


def size_for(keys: int) -> int:
    return min(MOST, max(LEAST, (16 * max(1, keys)).bit_length()))


def _places(keys: list[str]) -> Column:
    """The hashes of a key: the first bits of one find a word of the filter, the last six a bit within it."""
    return F.explode(F.array(*[F.xxhash64(F.lit(k), *keys) for k in range(HASHES)]))


def _word(h: Column, size: Column) -> Column:
    return F.call_function("shiftrightunsigned", h, (F.lit(70) - size).cast("int"))


def _bit(h: Column) -> Column:
    return h.bitwiseAND(F.lit(63)).cast("int")


def build(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """(word, bits): the words in which a key of ``rows`` sets a bit."""
    words = rows.select(_places(keys).alias("h")).select(_word(F.col("h"), F.lit(size)).alias("word"), _bit(F.col("h")).alias("bit"))
    return words.groupBy("word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bits"))


def passing(rows: DataFrame, keys: list[str], filters: DataFrame, sizes: list[int]) -> DataFrame:
    """(folder): those of ``filters`` (folder, size, word, bits) that a key of ``rows`` passes. ``sizes``: those that occur, some two dozen."""
    named = rows.select(*keys).distinct().select(F.xxhash64(*keys).alias("key"), _places(keys).alias("h"))
    asked = named.select("key", "h", F.explode(F.lit(sizes)).alias("size")).select("key", "size", _word(F.col("h"), F.col("size")).alias("word"), _bit(F.col("h")).alias("bit"))
    met = filters.join(asked, ["size", "word"]).where(F.call_function("shiftrightunsigned", "bits", F.col("bit")).bitwiseAND(F.lit(1)) == 1)
    # Two hashes of a key may find one bit, so it is set bits that are counted, not words.
    return met.groupBy("folder", "key").agg(F.count("*").alias("n")).where(F.col("n") >= HASHES).select("folder").distinct()
