"""Canonical exact fingerprints of whole texts.

A text is brought to a canonical form: NFKC, full case folding, NFKC again, white
space runs to single spaces, ends trimmed. Two xxHash64 values of it, of unlike
seeds, name its bucket. Buckets that hold more than one text are then compared
byte by byte; only where their canonical bytes differ does a SHA-256 of them tell
the members apart. So equal canonical texts always have equal fingerprints, and
unequal ones unequal fingerprints.

Normalising and folding are the ICU functions that Spark ships with, called from
SQL; no row leaves the JVM.

Documents meet their successor by doc_id in slices of the id range: each slice
also gets the first document of the next one, so a text moves once, and no task
sorts more than about a slice, however many documents there are and wherever their
ids lie: up to MAX_CUTS quantiles of the ids divide the range, each part is divided
evenly by id, rows are counted, and a slice of over LARGE times the aim is cut again
at its own quantiles, until none is left but those of one id. Only
hashes are kept of that pass. Buckets met twice are found among them; the texts
behind those alone are read again, by a filter on a hash of the text, and compared.

Defined results: a null text is empty, and its canonical form too; null doc_ids
come after all others; documents with one doc_id are ordered by their text; the
last document's successor is the first, a lone document's is itself; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bitfilter
from .common import documents, stash

#: Documents of a slice, about.
SLICE = 4_000
#: A slice of over so many times the aim is cut again, into so many.
LARGE, AGAIN = 3, 32
#: Quantiles of the ids that the driver holds, at most.
MAX_CUTS = 1_024
#: First ids of slices that are broadcast, at most; beyond, documents meet them by a join.
MOST_FIRSTS = 1_000_000

_NORMALIZER = "com.ibm.icu.text.Normalizer"
_CHARACTER = "com.ibm.icu.lang.UCharacter"


def canonical(text: Column) -> Column:
    """The canonical form; ``text`` must not be null."""
    call = lambda c, method, x: F.java_method(F.lit(c), F.lit(method), x, F.lit(True))
    folded = call(_NORMALIZER, "compose", call(_CHARACTER, "foldCase", call(_NORMALIZER, "compose", text)))
    return F.trim(F.regexp_replace(folded, r"[\s\p{Z}\x{85}]+", " "))


def wide(canon: Column) -> Column:
    """128 bits of xxHash64 in hexadecimal."""
    part = lambda *c: F.lower(F.lpad(F.hex(F.xxhash64(*c)), 16, "0"))
    return F.concat(part(canon), part(F.lit("wide"), canon))


def _key(text: str, prefix: str) -> list[Column]:
    """128 bits that name a raw text."""
    return [F.xxhash64(text).alias(f"{prefix}1"), F.xxhash64(F.lit("key"), text).alias(f"{prefix}2")]


def _texts_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(k1, k2, text): the different texts of ``docs`` that ``keys`` (k1, k2) name; all others stay where they are."""
    wanted = stash(keys.distinct(), "fingerprint-keys")
    log2_bits = bitfilter.bits_for(wanted.count())
    table = stash(bitfilter.build(wanted, "k1", log2_bits), "fingerprint-filter")
    some = bitfilter.flagged(documents(docs).select("text", *_key("text", "k")), F.col("k1"), table, "again", log2_bits).where("again")
    return some.groupBy("k1", "k2").agg(F.min("text").alias("text")).join(wanted, ["k1", "k2"], "left_semi")


def _tell_apart(members: DataFrame) -> DataFrame | None:
    """``members`` (wide, canon and names) with ``sha`` in place of canon, of the buckets whose canonical bytes differ; None where there are none."""
    compared = members.groupBy("wide").agg(F.min("canon").alias("least"), F.max("canon").alias("most"))
    collided = stash(compared.where("least <> most").select("wide"), "fingerprint-collisions")
    if not collided.limit(1).count():
        return None
    return stash(members.join(collided, "wide", "left_semi").withColumn("sha", F.sha2("canon", 256)).drop("canon"), "fingerprint-shas")


def _named(table: DataFrame, wide_hash: str, shas: DataFrame | None, on: list[str], into: str) -> DataFrame:
    """``table`` with the fingerprint ``into``: the wide hash, and a SHA-256 where its bucket holds different texts."""
    if shas is None:
        return table.withColumn(into, F.col(wide_hash))
    named = table.join(shas.select(*[F.col(c).alias(f"__{c}") for c in on], "sha").distinct(), [F.col(c) == F.col(f"__{c}") for c in on], "left")
    return named.withColumn(into, F.when(F.col("sha").isNull(), F.col(wide_hash)).otherwise(F.concat_ws("-", wide_hash, "sha"))).drop("sha", *[f"__{c}" for c in on])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every text."""
    hashed = documents(docs).select("doc_id", *_key("text", "k"), wide(canonical(F.col("text"))).alias("wide"))
    table = stash(hashed, "fingerprints")
    twice = table.groupBy("wide").agg(F.count("*").alias("n")).where("n > 1").select("wide")
    texts = _texts_of(docs, table.join(twice, "wide", "left_semi").select("k1", "k2"))
    members = texts.select("k1", "k2", canonical(F.col("text")).alias("canon")).withColumn("wide", wide(F.col("canon")))
    return _named(table, "wide", _tell_apart(members), ["k1", "k2"], "fingerprint").select("doc_id", "fingerprint")


def _longs(values: list[int]) -> Column:
    """An array literal; the planner folds it once."""
    return F.expr(f"cast(split('{','.join(map(str, values))}', ',') as array<bigint>)")


def _interval(cuts: list[int], id_: Column) -> Column:
    """How many of the sorted ``cuts`` are at most ``id_``, in two steps of about the root of their number."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    coarse = F.size(F.filter(_longs(cuts[::step]), lambda b: b <= id_))
    near = F.slice(_longs(cuts), F.greatest(coarse - 1, F.lit(0)) * step + 1, F.lit(step))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + F.size(F.filter(near, lambda b: b <= id_)))


def sliced(docs: DataFrame, slice_rows: int = SLICE, max_cuts: int = MAX_CUTS) -> DataFrame:
    """``docs`` with ``__slice``, which rises with doc_id; null ids come last, in one slice."""
    ends = docs.agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).first()
    slices = max(1, -(-ends.n // slice_rows))
    if ends.least is None:
        return docs.withColumn("__slice", F.lit(0).cast("long"))
    n_cuts = min(slices, max_cuts) - 1
    found = docs.agg(F.percentile_approx("doc_id", [k / (n_cuts + 1) for k in range(1, n_cuts + 1)], 20 * (n_cuts + 1)).alias("q")).first().q if n_cuts else []
    cuts = sorted(set(found) - {ends.least})
    parts = -(-slices // (len(cuts) + 1))
    at = _interval(cuts, F.col("doc_id"))
    low, high = F.get(_longs([ends.least, *cuts]), at).cast("double"), F.get(_longs([*cuts, ends.most]), at).cast("double")
    part = F.least(F.floor((F.col("doc_id").cast("double") - low) / F.greatest(high - low, F.lit(1.0)) * parts), F.lit(parts - 1).cast("long"))
    dealt = docs.withColumn("__slice", F.when(F.col("doc_id").isNull(), F.lit((len(cuts) + 1) * parts)).otherwise(at * F.lit(parts) + (part if parts > 1 else 0)).cast("long"))
    while True:
        counts = dealt.groupBy("__slice").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        large = stash(counts.where((F.col("n") > LARGE * slice_rows) & (F.col("low") < F.col("high"))).select("__slice"), "slices-large")
        if not (n := large.count()):
            return dealt
        some = lambda df: F.broadcast(df) if n <= MOST_FIRSTS else df  # noqa: B023, E731
        quantiles = F.percentile_approx("doc_id", [k / AGAIN for k in range(1, AGAIN)], 20 * AGAIN)
        ends = stash(dealt.join(some(large), "__slice").groupBy("__slice").agg(quantiles.alias("__q")), "slices-cut")
        # A quantile that many rows share begins their slice: what is below it is apart.
        place = F.coalesce(F.size(F.filter("__q", lambda x: x <= F.col("doc_id"))), F.lit(0))
        dealt = dealt.join(some(ends), "__slice", "left").withColumn("__slice", F.col("__slice") * AGAIN + F.when(F.col("__q").isNull(), 0).otherwise(place)).drop("__q")


def with_successor(docs: DataFrame, columns: list[str], slice_rows: int = SLICE, max_cuts: int = MAX_CUTS) -> DataFrame:
    """``docs`` (doc_id and ``columns``, text among them) with ``next_<column>`` of its successor by doc_id."""
    dealt = sliced(docs, slice_rows, max_cuts)
    ids = stash(dealt.groupBy("__slice").agg(F.min("doc_id").alias("__first")), "slice-firsts")  # a row for each slice
    before = F.lag("__slice").over(Window.orderBy("__slice"))
    last = F.max("__slice").over(Window.partitionBy())
    firsts = stash(ids.select("__slice", "__first", F.coalesce(before, last).alias("__previous")), "slice-previous")
    firsts = F.broadcast(firsts) if firsts.count() <= MOST_FIRSTS else firsts
    dealt = dealt.join(firsts, "__slice")
    own = F.struct(F.col("__slice").alias("to"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("__previous").alias("to"), F.lit(True).alias("guest"))
    is_first = F.col("doc_id").eqNullSafe(F.col("__first"))
    dealt = dealt.withColumn("__d", F.explode(F.when(is_first, F.array(own, guest)).otherwise(F.array(own))))
    dealt = dealt.select("doc_id", *columns, F.col("__d.to").alias("__to"), F.col("__d.guest").alias("__guest"))
    order = Window.partitionBy("__to").orderBy("__guest", F.col("doc_id").asc_nulls_last(), "text")
    following = dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return following.where(~F.col("__guest")).drop("__to", "__guest")


def edited_text() -> Column:
    """The text, its last half replaced by the first half's length of the successor's text."""
    half = F.floor(F.length("text") / 2).cast("int")
    return F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))


def compare_edits(docs: DataFrame, slice_rows: int = SLICE) -> DataFrame:
    """Fingerprints of every text and its edited text, and how alike they are (exact digests: 1 or 0)."""
    hashed = documents(docs).select("doc_id", "text", *_key("text", "k"), wide(canonical(F.col("text"))).alias("wide"))
    paired = with_successor(hashed, ["text", "k1", "k2", "wide"], slice_rows).withColumn("edited", edited_text())
    keys = ["k1", "k2", "next_k1", "next_k2"]
    table = stash(
        paired.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), *keys, "wide", "next_wide", wide(canonical(F.col("edited"))).alias("edited_wide")),
        "edit-fingerprints",
    )
    every = table.select("wide").unionByName(table.select(F.col("edited_wide").alias("wide")))
    twice = stash(every.groupBy("wide").agg(F.count("*").alias("n")).where("n > 1").select("wide"), "fingerprint-twice")
    # Copies are one row from here on: a bucket costs its different texts, and each edited text the two that it came from.
    own = stash(table.join(twice, "wide", "left_semi").select("k1", "k2").distinct(), "fingerprint-own")
    edits = stash(table.join(twice.withColumnRenamed("wide", "edited_wide"), "edited_wide", "left_semi").select(*keys).distinct(), "fingerprint-edits")
    texts = stash(_texts_of(docs, own.unionByName(edits.select("k1", "k2")).unionByName(edits.select(F.col("next_k1").alias("k1"), F.col("next_k2").alias("k2")))), "fingerprint-texts")
    following = texts.select(F.col("k1").alias("next_k1"), F.col("k2").alias("next_k2"), F.col("text").alias("next_text"))
    rebuilt = edits.join(texts, ["k1", "k2"]).join(following, ["next_k1", "next_k2"]).select(*keys, canonical(edited_text()).alias("canon"))
    whole = texts.join(own, ["k1", "k2"], "left_semi").select("k1", "k2", F.lit(None).cast("long").alias("next_k1"), F.lit(None).cast("long").alias("next_k2"), canonical(F.col("text")).alias("canon"))
    shas = _tell_apart(whole.unionByName(rebuilt).withColumn("wide", wide(F.col("canon"))))
    of_texts, of_edits = (None, None) if shas is None else (shas.where("next_k1 is null"), shas.where("next_k1 is not null"))
    named = _named(table, "wide", of_texts, ["k1", "k2"], "fingerprint")
    named = _named(named, "edited_wide", of_edits, keys, "edited_fingerprint")
    next_shas = of_texts and of_texts.select(F.col("k1").alias("next_k1"), F.col("k2").alias("next_k2"), "sha")
    named = _named(named, "next_wide", next_shas, ["next_k1", "next_k2"], "next_fingerprint")
    alike = lambda other: (F.col("fingerprint") == F.col(other)).cast("double")
    return named.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", alike("edited_fingerprint").alias("near_edited"), alike("next_fingerprint").alias("near_next"))
