"""One document of each near-duplicate class: SimHash over five-word shingles, then an exact check at Jaccard 0.8.

The 64-bit SimHash of two shingle sets of similarity 0.8 differs in about ten bits, so
the radius is RADIUS, not the few bits by which parts of the word could bring fingerprints
together. What brings them together is BANDS bands of ROWS minima each (MinHash): texts of
similarity 0.8 share none of them in 3 of a million cases, texts of similarity 0.1 share one
in 3 of ten thousand, so common lines and passages make few meetings. In a bucket:

1. Every member meets the smallest one; pairs within the radius are compared by their
   texts, and components are formed. A group of near copies costs a row a member here.
2. Where members are still of different components, their texts come to the bucket: they are
   compared bit plane by bit plane (``simhash.close_pairs``), pairs within the radius by
   their sets, and only links that join components leave the task. In a bucket too large for
   a task of which one component has half, only pairs with a member outside it are compared:
   a large group and a few strangers move in proportion to the group.

Texts with equal sets are one node, so exact copies never meet. Of similar pairs at 0.8, 6 in
a million are missed by design (bands 3, radius 3), fewer above; nothing is capped.

Shingles and sets go by 64-bit hashes. Defined results: only A-Z are lower-cased, words
stand between ASCII white space, fewer than five words are one shingle; null, empty and
blank texts are one class; classes are connected components; of a class the row with the
smallest doc_id stays (null last; of equal ids the smallest text hash, then any one);
repeated rows are copies; an empty table gives an empty result; extra columns are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import components
from ..staging import purge, staged
from . import bitfilter
from .common import fresh_name, stash, trim_memory
from .simhash import BLOCK, buckets, close_pairs

WIDTH = 5  # words in a shingle
SEED = 42
NUM, DEN = 4, 5  # the least similarity
RADIUS = 24
BANDS, ROWS = 32, 5
STEP = 2048  # shingles whose minima are taken at once
CACHED = 64  # sets kept while pairs are compared
CHUNK = 1024  # texts of a bucket that meet in one task, twice at most
WIDE = 1 << 22  # words of bits held at once while sets are compared

_RULE = np.random.default_rng(SEED)
_TIMES = _RULE.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RULE.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingles(text: bytes) -> np.ndarray:
    """The sorted different hashes of a UTF-8 text's shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    first = (ends - sizes + 1)[: max(1, len(words) - WIDTH + 1)].tolist()
    last = ends[min(WIDTH, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)), np.uint64, len(first)))


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def fingerprint(found: np.ndarray) -> int:
    """The SimHash of a set, as a signed long."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(found), 1 << 16):
        counts += np.unpackbits(found[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(found), bitorder="little").view(np.int64)[0])


def bands(found: np.ndarray) -> np.ndarray:
    """The keys (long) of a set's bands; an empty set has none."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), STEP):
        least = np.minimum(least, (found[at : at + STEP, None] * _TIMES + _PLUS).min(0))
    keys = [xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in least.reshape(BANDS, ROWS)]
    return np.array(keys, np.uint64).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (len(a) + len(b) - both)


_MARKS = T.StructType([T.StructField("node", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])


@F.arrow_udf(_MARKS)
def marks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """node (a digest of the set), n (its size), SimHash and band keys of each text."""
    kind = pa.struct([("node", pa.int64()), ("n", pa.int32()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64()))])
    for texts in batches:
        nodes, sizes, prints, keys = [], [], [], []
        for t in texts.to_pylist():
            found = shingles(_bytes(t))
            nodes.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
            sizes.append(len(found))
            prints.append(fingerprint(found))
            keys.append(bands(found))
        nodes = pa.array(np.array(nodes, np.uint64).view(np.int64), pa.int64())
        yield pa.StructArray.from_arrays([nodes, pa.array(sizes, pa.int32()), pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], fields=list(kind))
    trim_memory()


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b), stored, whose texts are similar; only texts of pairs move."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}

        def sets(row: int, text: str | None) -> np.ndarray:
            if row not in kept:
                if len(kept) >= CACHED:
                    kept.pop(next(iter(kept)))
                kept[row] = shingles(_bytes(text))
            return kept[row]

        for batch in batches:
            a, b, left, right = (batch.column(n) for n in ("a", "b", "left", "right"))
            ids = list(zip(a.to_pylist(), b.to_pylist(), strict=True))
            same = [similar(sets(x, left[k].as_py()), sets(y, right[k].as_py())) for k, (x, y) in enumerate(ids)]
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(same, pa.bool_())), b.filter(pa.array(same, pa.bool_()))], ["a", "b"])
        trim_memory()

    for end, text in (("b", "right"), ("a", "left")):
        ends = stash(pairs.select(F.xxhash64(end).alias("key")).distinct(), "neardup-ends")
        some = bitfilter.narrowed(texts, F.xxhash64("row"), ends, "neardup-filter")
        pairs = pairs.join(some.select(F.col("row").alias(end), F.col("text").alias(text)), end)
    return pairs.select("a", "b", "left", "right").mapInArrow(compare, "a long, b long")


def _sizes_fit(m: Column, n: Column) -> Column:
    return DEN * F.least(m, n) >= NUM * F.greatest(m, n)


def similar_pairs(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets i[k] and j[k] are similar, for each k.

    A shingle that one set alone holds is in no intersection; the others are numbered,
    and sets become rows of bits, as long as these stay within WIDE words.
    """
    met, n = np.unique(np.concatenate(sets), return_counts=True)
    met = met[n > 1]
    words = max(1, -(-len(met) // 64))
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    both = np.zeros(len(i), np.int64)
    if words * len(sets) <= WIDE:
        bits = np.zeros((len(sets), 64 * words), np.uint8)
        for k, found in enumerate(sets):
            bits[k, np.searchsorted(met, found[np.isin(found, met, assume_unique=True)])] = 1
        packed = np.packbits(bits, axis=1).view(np.uint64)
        step = max(1, WIDE // words)
        for at in range(0, len(i), step):
            both[at : at + step] = np.bitwise_count(packed[i[at : at + step]] & packed[j[at : at + step]]).sum(1)
    else:
        both[:] = [len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    return DEN * both >= NUM * (sizes[i] + sizes[j] - both)


class Joined:
    """Classes of a few rows that grow together: labels as given, joined by the links found."""

    def __init__(self, labels: np.ndarray):
        self.of = {x: x for x in labels.tolist()}

    def find(self, label: int) -> int:
        while self.of[label] != label:
            self.of[label] = label = self.of[self.of[label]]
        return label

    def join(self, a: int, b: int) -> bool:
        """Whether the classes were apart."""
        a, b = self.find(a), self.find(b)
        self.of[max(a, b)] = min(a, b)
        return a != b


def bucket_links(fp: np.ndarray, row: np.ndarray, n: np.ndarray, label: np.ndarray, of: np.ndarray, texts: np.ndarray, first: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Links that join the same labels as all similar pairs of rows of one bucket (``of``) do; ``first`` parts the rows in two chunks, of which pairs are made across."""
    sets: dict[int, np.ndarray] = {}
    left, right = (np.arange(len(fp)),) * 2 if first is None else (np.flatnonzero(first), np.flatnonzero(~first))
    joined = Joined(label)
    for i, j in close_pairs(fp[left].view(np.uint64), fp[right].view(np.uint64), RADIUS):
        i, j = left[i], right[j]
        now = np.array([joined.find(x) for x in label.tolist()])
        fits = (of[i] == of[j]) & (now[i] != now[j]) & (DEN * np.minimum(n[i], n[j]) >= NUM * np.maximum(n[i], n[j]))
        i, j = i[fits], j[fits]
        if first is None:
            i, j = i[i < j], j[i < j]
        if not len(i):
            continue
        used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        for k in used.tolist():
            if k not in sets:
                sets[k] = shingles(_bytes(texts[k]))
        same = similar_pairs([sets[k] for k in used.tolist()], at[: len(i)], at[len(i) :])
        for a, b in zip(i[same].tolist(), j[same].tolist(), strict=True):
            if joined.join(int(label[a]), int(label[b])):
                yield int(row[a]), int(row[b])


def across(met: DataFrame, chunk: int) -> DataFrame:
    """``met`` (k, part, row, label and more) dealt like ``simhash.dealt``, so that rows of different labels of a bucket meet.

    Of a bucket of over ``chunk`` rows, at least half of one label, the others' chunks
    meet the chunks of all; any other large bucket's chunks meet each other.
    """
    columns, kind = met.columns, "array<struct<lo:int,hi:int,first:boolean>>"
    per = met.groupBy("k", "part", "label").agg(F.count("*").alias("n"))
    sizes = per.groupBy("k", "part").agg(F.sum("n").alias("__members"), F.max_by("label", F.struct("n", "label")).alias("__major"), (F.sum("n") - F.max("n")).alias("__others")).where(F.col("__members") > chunk)
    count = lambda n: F.greatest(F.ceil(F.col(n) / chunk), F.lit(1)).cast("int")
    chunks, minor = count("__members"), count("__others")
    own = F.pmod(F.xxhash64("row"), chunks).cast("int")
    each = lambda n, f: F.transform(F.sequence(F.lit(0), n - 1), f).cast(kind)
    both = each(chunks, lambda x: F.struct(F.least(own, x).alias("lo"), F.greatest(own, x).alias("hi"), (own <= x).alias("first")))
    met_by = each(minor, lambda x: F.struct(x.alias("lo"), (minor + own).alias("hi"), F.lit(False).alias("first")))
    meeting = each(chunks, lambda x: F.struct(F.pmod(F.xxhash64("row"), minor).cast("int").alias("lo"), (minor + x).alias("hi"), F.lit(True).alias("first")))
    sided = F.when(F.col("label") == F.col("__major"), met_by).otherwise(F.concat(met_by, meeting))
    whole = F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(True).alias("first"))).cast(kind)
    places = F.when(F.col("__members").isNull(), whole).when(2 * F.col("__others") <= F.col("__members"), sided).otherwise(both)
    out = met.join(sizes, ["k", "part"], "left").select(*columns, F.explode(places).alias("p")).select(*columns, "p.lo", "p.hi", "p.first")
    return out.repartition("k", "part", "lo", "hi").sortWithinPartitions("k", "part", "lo", "hi")


def _apart(met: DataFrame) -> DataFrame:
    """Links (a, b) between rows of different labels in one bucket of ``met`` (k, part, row, n, fp, label, text)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        held: list[list[np.ndarray]] = []  # whole small buckets, compared together; a number tells them apart

        def flush_held() -> None:
            if held:
                out.extend(bucket_links(*[np.concatenate(c) for c in zip(*held, strict=True)]))
                held.clear()

        def emitted() -> Iterator[pa.RecordBatch]:
            if out:
                a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                out.clear()

        for number, (two, first, cols) in enumerate(buckets(batches, ("fp", "row", "n", "label", "text"))):
            cols = [*cols[:4], np.full(len(first), number), cols[4]]
            if two:
                out.extend(bucket_links(*cols, first))
            else:
                held.append(cols)
                if sum(len(c[0]) for c in held) >= BLOCK:
                    flush_held()
            if len(out) > 10_000:
                yield from emitted()
        flush_held()
        yield from emitted()
        trim_memory()

    return across(met, CHUNK).mapInArrow(compare, "a long, b long")


def links(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that join the same nodes as all similar pairs do; ``nodes`` (row, n, fp, bands; stored), ``texts`` (row, text)."""
    met = nodes.select("row", "n", "fp", F.posexplode("bands").alias("k", "part"))
    # Buckets of one are the rule: a filter keeps their rows from moving a second time.
    firsts = met.groupBy("k", "part").agg(F.min(F.struct("row", "n", "fp")).alias("first"), F.count("*").alias("m")).where("m > 1").drop("m")
    firsts = stash(firsts, "neardup-firsts")
    keys = stash(firsts.select(F.xxhash64("k", "part").alias("key")), "neardup-keys")
    met = stash(bitfilter.narrowed(met, F.xxhash64("k", "part"), keys, "neardup-filter").join(firsts, ["k", "part"]), "neardup-met")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("first.fp"))) <= RADIUS
    pairs = met.where((F.col("row") != F.col("first.row")) & near & _sizes_fit(F.col("n"), F.col("first.n")))
    pairs = stash(pairs.select(F.col("first.row").alias("a"), F.col("row").alias("b")).distinct(), "neardup-first")
    found = stash(_linked(pairs, texts), "neardup-links")
    labels = components(found).withColumnRenamed("id", "row")
    left = stash(met.drop("first").join(labels, "row", "left").withColumn("label", F.coalesce("label", "row")), "neardup-left")
    mixed = left.groupBy("k", "part").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("k", "part")
    rest = stash(left.join(stash(mixed, "neardup-mixed"), ["k", "part"], "left_semi"), "neardup-rest")
    rows = stash(rest.select(F.xxhash64("row").alias("key")).distinct(), "neardup-ends")
    some = stash(bitfilter.narrowed(texts, F.xxhash64("row"), rows, "neardup-filter"), "neardup-texts")
    return found.unionByName(stash(_apart(rest.join(some, "row").select("k", "part", "row", "n", "fp", "label", "text")), "neardup-links"))


def survivors(docs: DataFrame) -> DataFrame:
    """One row of each class, with its own columns only."""
    row, mark, since = fresh_name(docs, "row"), fresh_name(docs, "mark"), staged()
    held = stash(docs.select(*docs.columns, F.monotonically_increasing_id().alias(row), marks(F.col("text")).alias(mark)), "neardup-rows")
    rows = held.select(F.col(row).alias("row"), "doc_id", "text", *[F.col(f"{mark}.{c}").alias(c) for c in ("node", "n", "fp", "bands")])
    least = stash(rows.groupBy("node").agg(F.min("row").alias("row")), "neardup-nodes")
    nodes = stash(rows.select("row", "n", "fp", "bands").join(least.select("row"), "row", "left_semi"), "neardup-nodes")
    labels = components(links(nodes, rows.select("row", "text"))).withColumnRenamed("id", "row")
    named = stash(least.join(labels, "row", "left").select("node", F.coalesce("label", "row").alias("label")), "neardup-named")
    # First the best row of each node, combined before the shuffle: many copies are one row a task.
    rank_of = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", F.xxhash64("text").alias("hash"), "row")
    best = rows.groupBy("node").agg(F.min(rank_of).alias("best"))
    stay = best.join(named, "node").groupBy("label").agg(F.min("best").alias("best")).select("best.row")
    gone = stash(rows.select("row").join(stay, "row", "left_anti").select(F.col("row").alias(row)), "neardup-gone")
    # Rows that surely stay are passed on where they are; only the others move to meet the list of those that go.
    keys = gone.select(F.xxhash64(row).alias("key"))
    log2_bits = bitfilter.bits_for(gone.count())
    table = stash(bitfilter.build(keys, "key", log2_bits), "neardup-may")
    purge(docs.sparkSession, since, keep=("neardup-rows", "neardup-gone", "neardup-may"))
    marked = bitfilter.flagged(held.drop(mark), F.xxhash64(row), table, fresh_name(docs, "may"), log2_bits)
    may = F.col(fresh_name(docs, "may"))
    return marked.where(~may).select(*docs.columns).unionByName(marked.where(may).join(gone, row, "left_anti").select(*docs.columns))
