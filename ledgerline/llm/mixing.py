"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source has a word target from its weight. A target that holds whole epochs
takes every document once for each; the rest is a weighted sample without
replacement: a document's key is an exponential variate divided by its quality
weight, keys are sorted within the source, and documents are taken while the sum
of their sizes stays within the budget (the one at the border if that is nearer).

Keys come from a hash of the document, so reruns agree. A source is sorted in
slices of its keys, whose sums are added up first, so no task ever sorts a whole
source, however large. Weights go in STEPS steps, so the share of a source's keys
below any key is known from the documents of each weight: slices are cut where
equal numbers of documents are expected, whatever the weights.

Defined results: a null or empty text has size 0 and nothing to take; null
sources are one source, after all others; equal keys are ordered by doc_id and
text hash; rows that are equal in doc_id, text and source are numbered, and each
number has a key of its own (``mix`` spreads what they are taken over them
evenly); an empty table gives an empty result; extra columns are not read, except
by ``mix``, which passes them on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bitfilter
from .common import WORD, fresh_name, numbered, stash

#: Weights of the sources in order, repeating; the share of all words that the mix has.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
EPOCHS = 2
#: Documents of a slice, about.
SLICE = 2_000
#: Quality weights are multiples of 1 / STEPS.
STEPS = 20


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_step(text: Column) -> Column:
    """1 to STEPS: the share of a text's characters that are letters, white space or plain punctuation, cubed."""
    plain = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\s.,;:!?'-]", ""))
    share = F.coalesce(F.try_divide(plain, F.length(text)), F.lit(0.0))
    return F.greatest(F.lit(1), F.round(F.pow(share, F.lit(3.0)) * STEPS)).cast("int")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """source, n, source_size and target of every source (``sizes``: source, n, source_size).

    Targets rise in proportion to the weights until all words are given; one that
    reaches ``epochs`` times its source stays there. With sources in the order in
    which they get full, prefix sums give the level at which the rest stands.
    ``sizes`` has one row a source; a source list is a dimension, not data.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(order))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.lit(float(epochs)) * F.col("source_size"))
    full = Window.orderBy((F.col("cap") / F.col("weight")), "rank")
    everything = Window.partitionBy()
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    after = full.rowsBetween(0, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    # A source is full if the level reached with all earlier ones full is at its cap or over.
    stands = ranked.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") >= F.col("cap"))
    rest = F.min(F.when(~F.col("full"), F.struct("rank_full", "level"))).over(everything)["level"]
    stands = stands.withColumn("rank_full", F.row_number().over(full)).withColumn("rest", rest)
    target = F.when(F.col("rest").isNull() | F.col("full"), F.col("cap")).otherwise(F.col("rest") * F.col("weight"))
    return stands.select("source", "n", "source_size", target.alias("target"))


def _tie(seed: int) -> Column:
    return F.xxhash64("doc_id", F.col("doc_id").isNull(), "text", F.col("text").isNull(), "source", F.lit(seed))


def _key(tie: Column, copy: Column, step: Column) -> Column:
    uniform = (F.shiftrightunsigned(F.xxhash64(tie, copy), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(uniform) / (step / STEPS)


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, size, step, tie, copy, copies and key; equal documents are counted before they move and numbered after."""
    text = F.coalesce("text", F.lit(""))
    each = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), quality_step(text).alias("step"), _tie(seed).alias("tie"))
    counted = each.groupBy("doc_id", "source", "size", "step", "tie").agg(F.count("*").alias("copies"))
    each = numbered(counted.withColumn("n", F.col("copies")), "n", "copy")
    return each.withColumn("key", _key(F.col("tie"), F.col("copy"), F.col("step")))


def key_rank(key: Column, shares: Column) -> Column:
    """The expected share of keys below ``key``, where ``shares`` holds the share of documents of each step; it never falls as the key grows."""
    below = [F.get(shares, F.lit(k)) * (1 - F.exp(-key * F.lit((k + 1) / STEPS))) for k in range(STEPS)]
    return F.least(F.greatest(sum(below[1:], below[0]), F.lit(0.0)), F.lit(1.0))


def take(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = 9) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words) and epochs_taken of every document, with its slice, key, tie and copy."""
    base = stash(_keyed(docs, seed), "mix-keys")
    by_step = [F.avg((F.col("step") == k + 1).cast("double")) for k in range(STEPS)]
    sizes = stash(base.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"), F.array(*by_step).alias("shares")), "mix-sources")
    totals = stash(targets(sizes, weights, share, epochs), "mix-targets").join(sizes.select(F.col("source").alias("s"), "shares"), F.col("source").eqNullSafe(F.col("s")))
    totals = totals.drop("source")
    named = base.join(F.broadcast(totals) if totals.count() <= 10_000 else totals, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    slices = F.ceil(F.col("n") / SLICE)
    named = named.withColumn("slice", F.least(F.floor(key_rank(F.col("key"), F.col("shares")) * slices), slices - 1).cast("long")).drop("shares")
    inside = named.withColumn("within", F.sum("size").over(Window.partitionBy("source", "slice").orderBy("key", "tie", "doc_id", "copy").rowsBetween(Window.unboundedPreceding, 0)))
    sums = named.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    earlier = sums.withColumn("earlier", F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    earlier = earlier.select(F.col("source").alias("s"), F.col("slice").alias("t"), "earlier")
    summed = inside.join(earlier, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("t"))).drop("s", "t")
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(epochs))).otherwise(0).cast("int")
    budget = F.col("target") - F.col("whole") * F.col("source_size")
    upto = F.col("earlier") + F.col("within")
    # Within the budget, or across it by less than half of the document.
    picked = (F.col("whole") < epochs) & (F.col("size") > 0) & (upto - F.col("size") / 2.0 < budget)
    done = summed.withColumn("whole", whole).withColumn("epochs_taken", F.col("whole") + picked.cast("int"))
    return done.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("epochs_taken")).cast("long").alias("taken"), "epochs_taken", "whole", "slice", "key", "tie", "copy", "copies")


def mix(docs: DataFrame, seed: int = 9, **how) -> DataFrame:
    """The mixed documents: each row as often as it is taken, with its own columns.

    What is picked of a source is all up to some place in its order, so the place is
    all that a row needs to know: a row for each source is broadcast, and no text
    moves. Only rows that are equal to another one meet it, to share what they are taken.
    """
    names = {n: fresh_name(docs, n) for n in ("times", "tie", "at", "whole", "last", "of", "in")}
    times, tie, at, whole, last, of = (names[n] for n in ("times", "tie", "at", "whole", "last", "of"))
    taken = stash(take(docs, seed=seed, **how), "mix-taken")
    order = F.struct("key", "tie", "doc_id", "copy")
    per = taken.groupBy(F.col("source").alias(names["in"])).agg(F.max("whole").alias(whole), F.max(F.when(F.col("epochs_taken") > F.col("whole"), order)).alias(last))
    per = stash(per, "mix-places")
    per = F.broadcast(per) if per.count() <= 10_000 else per
    keyed = docs.withColumn(tie, _tie(seed))
    again = stash(taken.where("copies > 1").groupBy(F.col("tie").alias(tie)).agg(F.sum("epochs_taken").alias(times), F.max("copies").alias(of)), "mix-again")
    if again.limit(1).count():
        log2_bits = bitfilter.bits_for(again.count())
        table = stash(bitfilter.build(again, tie, log2_bits), "mix-filter")
        keyed = bitfilter.flagged(keyed, F.col(tie), table, at, log2_bits)
        met = keyed.where(at).join(again, tie, "left")
        single, equal = keyed.where(~F.col(at)).drop(at).unionByName(met.where(F.col(of).isNull()).drop(at, of, times)), met.where(F.col(of).isNotNull())
        place = F.row_number().over(Window.partitionBy(tie).orderBy(tie))
        equal = equal.withColumn(times, (F.floor(F.col(times) / F.col(of)) + (place <= F.col(times) % F.col(of)).cast("int")).cast("int"))
    else:
        single, equal = keyed, None
    placed = single.join(per, F.col("source").eqNullSafe(F.col(names["in"])))
    own = F.struct(_key(F.col(tie), F.lit(1).cast("long"), quality_step(F.coalesce("text", F.lit("")))).alias("key"), F.col(tie).alias("tie"), F.col("doc_id").alias("doc_id"), F.lit(1).cast("long").alias("copy"))
    words = size_of(F.col("text")) > 0  # what has none is never picked, though it stands in the order
    placed = placed.withColumn(times, F.col(whole) + F.when(F.col(last).isNotNull() & words & (own <= F.col(last)), 1).otherwise(0))
    rows = placed.select(*docs.columns, times)
    rows = rows if equal is None else rows.unionByName(equal.select(*docs.columns, times))
    return rows.where(F.col(times) > 0).withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
