"""Quality rules as a bitmask ledger.

Every rule is measured once for each text; its failure sets one bit of a long.
Policies (versioned sets of bits) and ablations then work on the ledger alone,
by bitwise operations, and never touch a text again.

Defined results: a null or empty text has no words, all measurements 0, and
fails ``few_words``; rows are independent, so ties, repeated rows and extra
columns (which are not read) change nothing; an empty table gives an empty
ledger; texts are measured whole, whatever their length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import trim_memory

#: Counted symbols, and white space that separates words.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")
LEDGER = T.StructType([T.StructField(m, T.LongType(), False) for m in MEASURES])


def measure(text: str) -> tuple[int, int, int, int, int, int]:
    """All measurements of one text, in the order of MEASURES."""
    # Words are split on the bytes: bytes.split() separates at ASCII white space alone.
    words = text.encode("utf-8", "surrogatepass").split()
    n_words = len(words)
    word_chars = len(text) - sum(map(text.count, SPACES))
    n_symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    n_dup_lines = len(lines) - len(set(lines))
    n_repeat = 0
    if n_words > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        seen = Counter(windows)
        if len(seen) < len(windows):
            reach = -1  # last word position counted so far
            for i, w in enumerate(windows):
                if seen[w] > 1:
                    n_repeat += i + 2 - max(reach, i - 1)
                    reach = i + 2
    return n_words, word_chars, n_symbols, n_dup_lines, len(lines), n_repeat


@F.arrow_udf(LEDGER)
def _measured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        rows = [measure(x or "") for x in texts.to_pylist()]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(MEASURES)
        yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=[pa.field(m, pa.int64(), False) for m in MEASURES])
    trim_memory()


@dataclass(frozen=True)
class Rule:
    """``fails(m)`` is a boolean column over the measurements struct ``m``."""

    name: str
    bit: int
    fails: object


def _rule_list() -> tuple[Rule, ...]:
    return (
        Rule("few_words", 0, lambda m: m["n_words"] < 50),
        Rule("repeated_windows", 1, lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
        Rule("symbols", 2, lambda m: 10 * m["n_symbols"] > m["n_words"]),
        Rule("duplicate_lines", 3, lambda m: (m["n_dup_lines"] >= 5) & (10 * m["n_dup_lines"] > 3 * m["n_lines"])),
        Rule("short_words", 4, lambda m: m["word_chars"] < 2 * m["n_words"]),
        Rule("long_words", 5, lambda m: m["word_chars"] > 15 * m["n_words"]),
        Rule("many_words", 6, lambda m: m["n_words"] > 100_000),
    )


#: A bit is never given to another rule, so that stored ledgers stay readable.
RULES = _rule_list()
BITS = {r.name: 1 << r.bit for r in RULES}

#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "duplicate_lines", "short_words", "long_words"),
    "v2": ("few_words", "repeated_windows", "symbols", "duplicate_lines", "short_words", "long_words", "many_words"),
}
DEFAULT_POLICY = "v1"


def policy_mask(policy: str) -> int:
    return sum(BITS[name] for name in POLICIES[policy])


def failure_bits(m: Column) -> Column:
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(rule.fails(m), F.lit(1 << rule.bit)).otherwise(0).cast("long"))
    return bits


def with_ledger(df: DataFrame, text: str, into: str) -> DataFrame:
    """``df`` with a struct column ``into``: the measurements, and ``bits``."""
    df = df.withColumn(into, _measured(F.col(text)))
    return df.withColumn(into, F.struct(F.col(f"{into}.*"), failure_bits(F.col(into)).alias("bits")))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and the failure bits of every document."""
    return with_ledger(docs.select("doc_id", "text"), "text", "m").select("doc_id", "m.*")


def apply_policy(table: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """The ledger with base_failed and kept under a stored policy."""
    return table.withColumns({
        "base_failed": F.col("bits").bitwiseAND(F.lit(policy_mask("base"))) != 0,
        "kept": F.col("bits").bitwiseAND(F.lit(policy_mask("base") | policy_mask(policy))) == 0,
    })


def ablations(table: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """For each rule of a policy: documents that fail it, fail it alone, and are kept without it.

    The ledger is first summed by its bits: at most 2**len(RULES) groups, so all
    counts come from one small table whatever the number of documents.
    """
    mask = policy_mask(policy)
    groups = table.groupBy(F.col("bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    each = [F.struct(F.lit(name).alias("rule"), F.lit(BITS[name]).cast("long").alias("bit")) for name in POLICIES[policy]]
    exploded = groups.select("bits", "n", F.explode(F.array(*each)).alias("r"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return exploded.groupBy(F.col("r.rule").alias("rule")).agg(
        total(F.col("bits").bitwiseAND(F.col("r.bit")) != 0).alias("n_fail"),
        total(F.col("bits") == F.col("r.bit")).alias("n_fail_alone"),
        total(F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0).alias("n_kept_without"),
    )


def keep(docs: DataFrame, tmp: str, policy: str = DEFAULT_POLICY) -> DataFrame:
    """The documents that a policy keeps, with their own columns."""
    mask = policy_mask("base") | policy_mask(policy)
    return with_ledger(docs, "text", tmp).filter(F.col(tmp)["bits"].bitwiseAND(F.lit(mask)) == 0).drop(tmp)
