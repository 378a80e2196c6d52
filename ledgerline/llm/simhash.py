"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints are 64 bits wide. Two of them within ``radius`` bits agree wholly in
one of ``radius + 1`` parts of the word (or in k of k + radius parts), so only
fingerprints that share such a part meet. Where they meet, they are held as bit
planes: plane b holds bit b of 64 fingerprints in each machine word. Distances of
many pairs grow together, plane by plane, in carry-save counters, and a block is
abandoned once every distance in it exceeds the radius.

Defined results: a null or empty text, or one without words, has fingerprint 0
and links like any other; equal fingerprints are one node (copies never make
pairs); rows with a null doc_id get the smallest non-null doc_id of their class,
else null; repeated rows give repeated result rows; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import components
from .common import fresh_name, stash, trim_memory

WIDTH = 4  # words in a shingle
SEED = 42
RADIUS = 4
STEP = 1 << 16  # shingles hashed at once: bounds memory on very long texts
BLOCK = 192  # fingerprints of small buckets compared at once
ROWS = 256  # rows of a comparison tile
LANES = 8192  # columns of a comparison tile
CHUNK = 16384  # buckets with more fingerprints are compared chunk by chunk
#: The mean bucket aimed at, which decides the number of parts.
BUCKET = 64


def simhash(text: bytes, width: int = WIDTH) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text; only A-Z are lower-cased."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    n = max(1, len(words) - width + 1)
    first, last = starts[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, STEP):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(first[at : at + STEP], last[at : at + STEP], strict=True)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


@F.arrow_udf(T.LongType())
def fingerprint(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The SimHash as a signed long of the same bits."""
    for texts in batches:
        values = np.array([simhash((x or "").encode("utf-8", "surrogatepass")) for x in texts.to_pylist()], np.uint64)
        yield pa.array(values.view(np.int64), pa.int64())
    trim_memory()


def _planes(values: np.ndarray) -> np.ndarray:
    """(64, words): bit b of value i is bit i of row b."""
    lanes = -(-len(values) // 64) * 64
    bits = np.zeros((lanes, 64), np.uint8)
    bits[: len(values)] = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def close_pairs(left: np.ndarray, right: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes (i, j) with left[i] and right[j] at most ``radius`` bits apart, tile by tile: at most ROWS * LANES pairs at once."""
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    for c in range(0, len(right), LANES):
        block = right[c : c + LANES]
        planes = _planes(block)
        valid = np.packbits(np.arange(planes.shape[1] * 64) < len(block), bitorder="little").view(np.uint64)
        for r in range(0, len(left), ROWS):
            rows = left[r : r + ROWS]
            masks = np.where((rows[None, :] >> np.arange(64, dtype=np.uint64)[:, None]) & np.uint64(1), ones, np.uint64(0))
            shape = (len(rows), planes.shape[1])
            counts = [np.zeros(shape, np.uint64) for _ in range(max(1, radius.bit_length()))]
            over, far = np.zeros(shape, np.uint64), np.zeros(shape, np.uint64)
            for b in range(0, 64, 2):
                d, e = planes[b] ^ masks[b][:, None], planes[b + 1] ^ masks[b + 1][:, None]
                half = counts[0] ^ d
                carry = (counts[0] & d) | (half & e)  # carry-save: two planes enter at once
                counts[0] = half ^ e
                for k in range(1, len(counts)):
                    up = counts[k] & carry
                    counts[k] ^= carry
                    carry = up
                over |= carry
                if b % 8 == 6:
                    far = over | _exceeds(counts, radius)
                    if ((far | ~valid) == ones).all():
                        break
            else:
                hits = np.unpackbits((~far & valid).view(np.uint8), axis=1, bitorder="little")
                i, j = np.nonzero(hits)
                yield i + r, j + c


def _exceeds(counts: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count (bit k in counts[k]) is over the radius."""
    above, equal = np.zeros_like(counts[0]), ~np.zeros_like(counts[0])
    for k in reversed(range(len(counts))):
        if radius >> k & 1:
            equal = equal & counts[k]
        else:
            above |= equal & counts[k]
            equal = equal & ~counts[k]
    return above


def spanning_links(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that join the same fingerprints as all close pairs do: each member with its class's first."""
    values = left if right is None else np.concatenate([left, right])
    root = np.arange(len(values))
    for i, j in close_pairs(left, left if right is None else right, radius):
        if right is not None:
            j = j + len(left)
        while True:  # classes that a pair joins take the smaller label
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            parent = np.arange(len(values))
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while (parent != parent[parent]).any():
                parent = parent[parent]
            root = parent[root]
    signed = values.view(np.int64)
    return [(int(signed[k]), int(signed[root[k]])) for k in np.flatnonzero(root != np.arange(len(root)))]


def plan_parts(n: int, radius: int = RADIUS) -> tuple[int, int]:
    """(parts, shared): fingerprints meet if ``shared`` of ``parts`` parts are equal."""
    for shared in (1, 2, 3, 4):
        parts = shared + radius
        if n >> (64 * shared // parts) <= BUCKET:
            break
    return parts, shared


def _keys(parts: int, shared: int) -> list[tuple[int, int]]:
    """(key number, mask) for each choice of parts."""
    cuts = [64 * k // parts for k in range(parts + 1)]
    masks = [((1 << cuts[k + 1]) - 1) ^ ((1 << cuts[k]) - 1) for k in range(parts)]
    return [(n, sum(masks[k] for k in chosen)) for n, chosen in enumerate(combinations(range(parts), shared))]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def dealt(met: DataFrame, chunk: int | None = None) -> DataFrame:
    """``met`` (k, part, fp and more) grouped for comparison: rows of one (k, part, lo, hi) stand together in a partition.

    Buckets of over ``chunk`` (CHUNK) rows are dealt into chunks by a hash of their
    rows, and the chunks meet two by two, in tasks of their own; no pair is left out.
    ``first`` tells which of the two chunks a row belongs to.
    """
    chunk = chunk or CHUNK
    own_columns = met.columns
    sizes = met.groupBy("k", "part").agg(F.count("*").alias("__members")).where(F.col("__members") > chunk)
    met = met.join(sizes, ["k", "part"], "left")
    chunks = F.ceil(F.coalesce("__members", F.lit(1)) / chunk).cast("int")
    own = F.pmod(F.xxhash64(*own_columns), chunks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), chunks - 1), lambda x: F.struct(F.least(own, x).alias("lo"), F.greatest(own, x).alias("hi")))
    each = met.select(*own_columns, own.alias("own"), F.explode(pairs).alias("p")).select(*own_columns, "p.lo", "p.hi", (F.col("own") == F.col("p.lo")).alias("first"))
    return each.repartition("k", "part", "lo", "hi").sortWithinPartitions("k", "part", "lo", "hi")


def buckets(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[bool, np.ndarray, list[np.ndarray]]]:
    """Of rows that ``dealt`` grouped, bucket by bucket: whether it is a pair of chunks, which rows are of the first one, and the columns ``names``."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        cols = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("k", "part", "lo", "hi", "first", *names)]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        k, part, lo, hi, first = cols[:5]
        cuts = np.flatnonzero((np.diff(k) != 0) | (np.diff(part) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0)) + 1
        edges = [0, *cuts.tolist()]
        for s, e in zip(edges, edges[1:], strict=False):
            yield bool(lo[s] != hi[s]), first[s:e].astype(bool), [c[s:e] for c in cols[5:]]
        rest = [c[edges[-1] :] for c in cols]
    if rest is not None and len(rest[0]):
        yield bool(rest[2][0] != rest[3][0]), rest[4].astype(bool), rest[5:]


def links(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Spanning links (a, b) among distinct fingerprints (``fp`` long) within the radius."""
    parts, shared = plan_parts(fingerprints.count(), radius)
    keys = F.array(*[F.struct(F.lit(n).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part")) for n, m in _keys(parts, shared)])
    met = fingerprints.select("fp", F.explode(keys).alias("x")).select("x.k", "x.part", "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: set[tuple[int, int]] = set()
        held: list[np.ndarray] = []  # whole small buckets, compared together

        def flush_held() -> None:
            if held:
                out.update(spanning_links(np.unique(np.concatenate(held)), None, radius))
                held.clear()

        def emitted() -> Iterator[pa.RecordBatch]:
            if out:
                a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                out.clear()

        for two, first, (fp,) in buckets(batches, ("fp",)):
            fp = fp.view(np.uint64)
            if two:
                out.update(spanning_links(fp[first], fp[~first], radius))
            elif len(fp) > 1:
                held.append(fp)
                if sum(map(len, held)) >= BLOCK:
                    flush_held()
            if len(out) > 10_000:
                yield from emitted()
        flush_held()
        yield from emitted()
        trim_memory()

    return dealt(met).mapInArrow(compare, "a long, b long")


def _labelled(prints: DataFrame, radius: int) -> DataFrame:
    """fp, least_id and class label of the different fingerprints of ``prints`` (doc_id, fp)."""
    nodes = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-nodes")
    joined = components(links(nodes.select("fp"), radius))
    named = nodes.join(joined.withColumnRenamed("id", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    return stash(named, "simhash-named")


def classes(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp (signed) and component_id of every row of ``docs``."""
    prints = stash(docs.select("doc_id", fingerprint(F.col("text")).alias("fp")), "simhash")
    named = _labelled(prints, radius)
    # Stored, so that adaptive execution can split the rows of a large class in the join.
    least = stash(named.groupBy("label").agg(F.min("least_id").alias("component_id")), "simhash-least")
    return prints.join(named.join(least, "label").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp):  # a column of 16 lower-case hex digits
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def survivors(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each class: that of the smallest doc_id (null last); its own columns only.

    Of equal doc_ids, the row whose text has the smallest hash stays.
    """
    row, fp = fresh_name(docs, "row"), fresh_name(docs, "fp")
    held = stash(docs.select(*docs.columns, F.monotonically_increasing_id().alias(row), fingerprint(F.col("text")).alias(fp)), "simhash-rows")
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", F.xxhash64("text").alias("hash"), F.col(row).alias("row"))
    best = held.groupBy(F.col(fp).alias("fp")).agg(F.min(order).alias("best"))
    named = _labelled(held.select("doc_id", F.col(fp).alias("fp")), radius).select("fp", "label")
    stay = best.join(named, "fp").groupBy("label").agg(F.min("best").alias("best")).select(F.col("best.row").alias(row))
    return held.join(stay, row, "left_semi").select(*docs.columns)
