"""Spelling variants: words one edit apart, found by their three rarest bigrams.

Occurrences are counted within tasks before they are shuffled. Bigrams are ordered
by the number of words that hold them (ties: by the bigram), which is one global
order. A word proposes itself under its three rarest bigrams, each with its place.
One edit destroys two bigrams at most and leaves a word's others in place, counted
from the front if they stand before it and from the back if they stand behind it.
Those that stay are in the same order in both words (equal bigrams by place), and at
most two others come before the first of them; so it is among the three rarest of
both. The join's key says all that the place limits: the bigram with what stands
before it, or with what stands behind it, and the shorter word's length. Proposed
pairs are verified, by their letters first, then by edit distance.

Nothing is capped: keys that many words share are split by adaptive execution, as
both sides of the join are stored tables. The number of bigrams is bounded by the
letters (``LETTERS`` squared), so their order may go to every task.

Defined results: null and empty texts have no words; a null doc_id counts as an
empty one in the hash; a repeated row counts again; ties of forms go to the
smallest word; texts and words of any length are taken whole; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, stash, trim_memory

LEAST_LENGTH = 7
LEAST_COUNT = 2
#: A form occurs at least so many times as often as its variant.
DOMINANCE = 10
#: Occurrences whose hash is divisible by this lose a letter.
DAMAGE = 31
#: a to z, and U+00C0 to U+00FF; capital A to Z are lower-cased.
LETTERS = 26 + 64
PREFIX = 3
#: Different words that a task holds before it passes their counts on.
HELD = 200_000

_RUN = re.compile(rf"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}")


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n): counts of damaged and undamaged runs, combined as far as ``HELD`` allows."""
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})
        counts.clear()
        return batch

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            # Lower-casing bytes changes A to Z alone.
            for run, n in Counter(_RUN.findall(text.encode().lower().decode())).items():
                h = zlib.crc32(run.encode(), start)
                if h % DAMAGE == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                    if len(run) < LEAST_LENGTH:
                        continue
                counts[run] += n
        while len(counts) >= HELD:
            yield out()
    yield out()
    trim_memory()


def words(docs: DataFrame) -> DataFrame:
    """(word, n) of the words that occur often enough."""
    parts = documents(docs).mapInArrow(_occurrences, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def bigram_order(counted: DataFrame) -> dict[str, int]:
    """Bigram -> its place from the rarest on; at most ``LETTERS`` squared of them."""
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda k: F.substring(F.col("word"), k, F.lit(2))))
    rows = counted.select(F.explode(grams).alias("gram")).groupBy("gram").count().collect()
    return {r.gram: k for k, r in enumerate(sorted(rows, key=lambda r: (r["count"], r.gram)))}


def proposals(word: str, order: dict[str, int]) -> Iterator[str]:
    """The word's rarest bigrams (ties: the first), each with all before it, then with all behind it."""
    for _, k in heapq.nsmallest(PREFIX, ((order[word[k : k + 2]], k) for k in range(len(word) - 1))):
        yield f"<{word[: k + 2]}"
        yield f">{word[k:]}"


def _keyed(order: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"key": [], "longer": [], "letters": [], "word": [], "n": []}
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                letters = 0
                for c in word:
                    letters |= 1 << (ord(c) % 63)
                size = len(word)
                for part in proposals(word, order):
                    for shorter in (size, size - 1):
                        # A signed 64-bit key; a chance collision is met by the check of the edit distance.
                        out["key"].append(xxhash.xxh64_intdigest(f"{shorter}{part}") - (1 << 63))
                        out["longer"].append(shorter < size)
                        out["letters"].append(letters)
                        out["word"].append(word)
                        out["n"].append(n)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, v), t in zip(out.items(), (pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.int64()), strict=True)})
        trim_memory()

    return run


def near_pairs(counted: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): every pair of words one edit apart, once."""
    keyed = stash(counted.mapInArrow(_keyed(bigram_order(counted)), "key long, longer boolean, letters long, word string, n long"), "variant-keys")
    left = keyed.where("not longer").select("key", F.col("letters").alias("letters_a"), F.col("word").alias("a"), F.col("n").alias("n_a"))
    right = keyed.select("key", "longer", F.col("letters").alias("letters_b"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    alike = F.bit_count(F.col("letters_a").bitwiseXOR(F.col("letters_b"))) <= 2
    near = left.join(right, (left.key == right.key) & alike & (F.col("longer") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    return near.select("a", "n_a", "b", "n_b").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms followed to the last; each pass doubles the way, and forms grow tenfold a step."""
    ups = stash(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        above = ups.select(F.col("word").alias("root"), F.col("root").alias("above"))
        moved = stash(ups.join(above, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "variant-roots")
        ups = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return ups


def group(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    counted = stash(words(docs), "variant-words")
    pairs = stash(near_pairs(counted), "variant-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("near_n"), F.col("near"))).alias("best"))
    best = best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.col1")).alias("near_n"))
    told = F.col("near_n") >= DOMINANCE * F.col("n")
    formed = counted.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(told, F.col("near")).alias("form"), F.when(told, F.col("near_n")).alias("form_n"))
    formed = stash(formed, "variant-forms")
    roots = _roots(formed.where("form is not null"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
