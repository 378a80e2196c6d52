"""A hierarchical Pitman-Yor language model: seating sampled by Gibbs, probabilities averaged.

Each word is a restaurant for the words that follow it; all share one parent, the
restaurant of words without context, whose parent is uniform over the known words
and one for all unknown ones. A restaurant's state is how many tables serve a dish;
each table sends one customer to the parent. A sweep draws the tables of every dish
anew from its conditional, given the rest of the last sweep: exactly, by
generalised Stirling numbers, up to ``EXACT`` customers, and beyond it by seating
them in blocks of a sixteenth. Concentrations are drawn from a grid (griddy Gibbs);
discounts come from the counts of counts. Kept sweeps' predictive probabilities are
averaged; a text's score is the sum of their logarithms. A text begins in the
context of the end token.

How it is laid out. Texts are tokenised once, into parts of about ``PART_BYTES``
with their own numbering; tokens never leave their part again. A part asks for each
different pair of words once, in the bucket of the pair's context. A bucket adds up
the counts, holds the seating of its contexts, and answers with what a part can't
know: pairs that occur twice or elsewhere. Contexts of over ``SLICE`` tokens are cut
in slices by the following word; a sweep takes their tables, in all slices, from the
last one, as it does those of whole contexts, so a cut changes no conditional. Which
contexts these are, and their tables, is told to all tasks (at most
``MOST_HOT``, as each holds at least that share of all tokens; beyond ``SLICE`` *
``MOST_HOT`` tokens the largest slices grow with the corpus). The parent's state is
dealt in buckets by word; each bucket of contexts asks for its words, and sends what
its tables send. Nothing grows on the driver: it gets sums. Long columns of numbers
are binary: only Python reads them, and the JVM moves each as one value.

Defined results: null and empty texts hold the end token alone; a null doc_id
counts as an empty text in the hash, so it trains; repeated rows train and are
scored each; texts are taken whole; other columns are ignored; an empty table gives
an empty result; without training texts every probability is that of the one
unknown word, which is 1. Draws depend on the data alone: reruns agree.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce
from inspect import signature

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import LARGE_ROWS, purge, staged
from .common import documents, free_shuffles, staging_path, stash, trim_memory

BURN_IN, KEPT = 1, 2
#: Bytes of text in a part; pairs that a bucket is to hold; tokens of a context from which it is cut.
PART_BYTES, BUCKET, SLICE, MOST_HOT = 5_000_000, 1_500_000, 500_000, 2**17
EXACT = 40
#: Parts are scored in so many lots, one after the other, so that only one's tokens are in a shuffle.
LOTS = 3
#: Parts have random numbers below this.
_LAST = 1 << 62
#: The concentrations that are tried.
GRID = 0.25 * 2.0 ** np.arange(16)
END = b"\n"

#: Token ids are kept as two planes of 16 bits, of which the upper one is nearly empty.
_PARTS = "part long, doc_ids array<long>, held array<boolean>, sizes array<int>, low binary, high binary, vocab binary"
_ASKED = "bucket int, part long, us binary, runs binary, ws binary, ks binary"
_SEATED = "bucket int, u binary, w binary, c binary, ctx binary, ctx_c binary, slices binary, hist_c binary, hist_n binary, t binary, past binary, cut_u array<long>, cut_c array<long>, cut_t array<long>"
_PAIRS = f"{_SEATED}, seated long, twos long, n_parts binary, parts binary, places binary, one_parts binary, one_places binary"
_SEATS = f"{_SEATED}, fit array<double>"
_TOLD = "part long, bucket int, place binary, pc binary, pt binary"
_COUNTED = "of int, hs binary, cs binary, ns binary"
_WORDS = "of int, h binary, c binary, total long, known long, ones long, twos long, large array<long>, large_n array<long>"
_STATE = "of int, h binary, c binary, a binary, kept binary, customers long, tables long"
_NEEDED = "of int, bucket int, h binary"
_PARENTS = "bucket int, h binary, p binary"
_SPARED = "of int, h binary, e binary"
_SUMMARY = "of int, h binary, c binary, wp binary, we binary"
_WANTED = "of int, part long, hs binary"
_FACTS = "part long, of int, wc binary, wp binary, we binary"
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
#: The numbers in binary columns, where they are not 64-bit integers.
_KINDS = {"low": np.uint16, "high": np.uint16} | dict.fromkeys(("runs", "ks", "n_parts", "places", "one_places", "place"), np.int32) | dict.fromkeys(("a", "kept", "p"), np.float64) | {"wp": np.float32}
#: Writer options for rows of large binary values, among which none repeats.
_LARGE = {**LARGE_ROWS, "parquet.enable.dictionary": "false", "compression": "zstd"}


def _kind(name: str) -> np.dtype:
    return np.dtype(_KINDS.get(name, np.int64))


def _rows(schema: str, **columns) -> pa.RecordBatch:
    """A batch by a DDL schema: plain columns as arrays, list and binary columns as one value or (numbers, bounds)."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    out = {}
    for field in schema.split(", "):
        name, kind = field.split(" ")
        given = columns[name]
        if kind in kinds:
            out[name] = pa.array(given, kinds[kind])
            continue
        values, bounds = given if isinstance(given, tuple) else (given, [0, len(given)])
        if kind == "binary":
            values = np.ascontiguousarray(values, _kind(name))
            ends = np.asarray(bounds, np.int64) * values.itemsize
            if ends[-1] >= 1 << 31:
                raise ValueError(f"{name}: more than 2 GB in a batch")
            out[name] = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values)])
        else:
            out[name] = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kinds[kind[6:-1]]))
    return pa.RecordBatch.from_pydict(out)


def _no_rows(schema: str) -> pa.Table:
    whole = _rows(schema, **{f.split(" ")[0]: [] if f.endswith((">", "binary")) else [0] for f in schema.split(", ")})
    return pa.Table.from_batches([whole.slice(0, 0)])


def _chunks(column) -> list[pa.Array]:
    return column.chunks if isinstance(column, pa.ChunkedArray) else [column]


def _numbers(chunk: pa.Array, kind: np.dtype) -> np.ndarray:
    """The values of a chunk, of all of its lists, or of all of its binary values, these without a copy."""
    if pa.types.is_list(chunk.type):
        chunk = chunk.flatten()
    if not (pa.types.is_binary(chunk.type) or pa.types.is_large_binary(chunk.type)):
        return chunk.to_numpy(zero_copy_only=False)
    if not len(chunk):
        return np.empty(0, kind)
    _, ends, data = chunk.buffers()
    ends = np.frombuffer(ends, np.int32 if pa.types.is_binary(chunk.type) else np.int64)
    first, last = int(ends[chunk.offset]), int(ends[chunk.offset + len(chunk)])
    return np.frombuffer(data, kind, (last - first) // kind.itemsize, first) if last > first else np.empty(0, kind)


def _flat(table, name: str) -> np.ndarray:
    """All numbers of a column."""
    found = [_numbers(c, _kind(name)) for c in _chunks(table.column(name))]
    return found[0] if len(found) == 1 else np.concatenate(found) if found else np.empty(0, _kind(name))


def _lengths(table, name: str) -> np.ndarray:
    """How many numbers each row of a binary column has."""
    found = [pc.binary_length(c).to_numpy(zero_copy_only=False) // _kind(name).itemsize for c in _chunks(table.column(name))]
    return np.concatenate(found).astype(np.int64) if found else np.empty(0, np.int64)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Rows of list columns as dicts of arrays."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            yield _with_ids({name: _flat(row, name) for name in row.schema.names})
    trim_memory()


def _trimmed(run):
    """A group's function that gives its memory back when it is done: workers stay, and share the executor's limit."""

    def group(*tables: pa.Table) -> pa.Table:
        out = run(*tables)
        trim_memory()
        return out

    return (lambda a: group(a)) if len(signature(run).parameters) == 1 else (lambda a, b: group(a, b))


def _with_ids(part: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """A part with its token ids in one piece; other rows as they are."""
    if "low" in part:
        part["ids"] = part.pop("low").astype(np.int64) | (part.pop("high").astype(np.int64) << 16)
    return part


# Tokens


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = k = len(self)
        return k


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, rows, size = _Ids({END: 0}), [], 0

    def out() -> pa.RecordBatch:
        vocab = [xxhash.xxh64_intdigest(w) - (1 << 63) for w in ids]
        docs, held, arrays = zip(*rows, strict=True)
        ids_ = np.concatenate(arrays)
        return _rows(_PARTS, part=[uuid.uuid4().int % _LAST], doc_ids=list(docs), held=list(held), sizes=[len(a) for a in arrays], low=(ids_ & 0xFFFF).astype(np.uint16), high=(ids_ >> 16).astype(np.uint16), vocab=vocab)

    for batch in batches:
        for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            # Lower-casing and splitting bytes knows ASCII alone.
            words = raw.lower().split()
            words.append(END)
            held = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1
            rows.append((doc_id, held, np.fromiter(map(ids.__getitem__, words), np.int32, len(words))))
            size += len(raw)
            if size >= PART_BYTES:
                yield out()
                ids, rows, size = _Ids({END: 0}), [], 0
    if rows:
        yield out()
    trim_memory()


def _train(part: dict[str, np.ndarray]) -> np.ndarray:
    return np.repeat(~part["held"].astype(bool), part["sizes"])


def _codes(part: dict[str, np.ndarray]) -> np.ndarray:
    """Each token's pair: context id * words + id."""
    ids = part["ids"]
    codes = np.empty_like(ids)
    codes[1:] = ids[:-1]
    codes[0] = 0  # the end token has id 0, and stands before the first token of every text
    codes *= len(part["vocab"])
    codes += ids
    return codes


def _pairs_of(part: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The part's different pairs, and how often its training tokens have them. Sorted in place, for memory."""
    codes, train = _codes(part), _train(part)
    mine, held = codes[train], codes[~train]
    del codes
    mine.sort()
    held.sort()
    first = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]]) if len(mine) else np.empty(0, np.int64)
    k = np.diff(np.r_[first, len(mine)]).astype(np.int32)
    mine = mine[first]
    held = held[np.r_[True, held[1:] != held[:-1]]] if len(held) else held
    if len(mine) and len(held):
        held = held[mine[np.minimum(np.searchsorted(mine, held), len(mine) - 1)] != held]
    every = np.r_[mine, held]
    order = np.argsort(every, kind="stable")
    return every[order], np.r_[k, np.zeros(len(held), np.int32)][order]


def _runs(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stable order of numbers by bucket, the buckets that occur, and where each begins."""
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")  # 16 bits: a radix sort
    sorted_ = bucket[order]
    first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(order) else np.empty(0, np.int64)
    return order, sorted_[first], np.r_[first, len(order)]


def _by_word(words: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of words by the bucket of their hash, the buckets, and where each begins."""
    return _runs(words % buckets, buckets)


def _place(words: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Where each word that is asked for stands among ``words``."""
    order = np.argsort(words)
    return order[np.searchsorted(words[order], asked)]


def _counts(buckets: int):
    """How often a part's words occur, in training texts and in all, by the bucket of the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _each(batches):
            order, met, bounds = _by_word(part["vocab"], buckets)
            c, n = (np.bincount(ids, minlength=len(order))[order] for ids in (part["ids"][_train(part)], part["ids"]))
            yield _rows(_COUNTED, of=met, hs=(part["vocab"][order], bounds), cs=(c, bounds), ns=(n, bounds))

    return run


def _sums(least: int):
    """One bucket's words; ``least``: occurrences in all from which a word is told by itself."""

    def run(counted: pa.Table) -> pa.Table:
        h = _flat(counted, "hs")
        order = np.argsort(h)
        h = h[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        h, c, n = h[first], np.add.reduceat(_flat(counted, "cs")[order], first), np.add.reduceat(_flat(counted, "ns")[order], first)
        sums = {"total": [c.sum()], "known": [(c > 0).sum()], "ones": [(c == 1).sum()], "twos": [(c == 2).sum()]}
        return pa.Table.from_batches([_rows(_WORDS, of=[counted["of"][0].as_py()], h=h, c=c, large=h[n >= least], large_n=n[n >= least], **sums)])

    return run


def _ask_words(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _each(batches):
            order, met, bounds = _by_word(part["vocab"], buckets)
            yield _rows(_WANTED, of=met, part=np.repeat(part["part"], len(met)), hs=(part["vocab"][order], bounds))

    return run


def _tell_words(asked: pa.Table, facts: pa.Table) -> pa.Table:
    """What a bucket's words are, to each part that asked, in the order of its words."""
    if not asked.num_rows:
        return _no_rows(_FACTS)
    row = _place(_flat(facts, "h"), _flat(asked, "hs"))
    bounds = np.r_[0, np.cumsum(_lengths(asked, "hs"))]
    each = lambda name: _flat(facts, name).reshape(-1, KEPT)[row].ravel()
    return pa.Table.from_batches([_rows(_FACTS, part=_flat(asked, "part"), of=_flat(asked, "of"), wc=(_flat(facts, "c")[row], bounds), wp=(each("wp"), bounds * KEPT), we=(each("we"), bounds * KEPT))])


# Buckets of contexts


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _slices(u: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """In how many slices each context is cut; hot: sorted contexts, and their slices."""
    if not len(hot[0]):
        return np.ones(len(u), np.int64)
    at = np.minimum(np.searchsorted(hot[0], u), len(hot[0]) - 1)
    return np.where(hot[0][at] == u, hot[1][at], 1)


def _dealt(codes: np.ndarray, vocab: np.ndarray, buckets: int, hot: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order in which a part asks for its pairs: by bucket, then context; the buckets, and where each begins."""
    u, w = vocab[codes // len(vocab)], vocab[codes % len(vocab)]
    slice_ = _mixed(w) % _slices(u, hot).astype(np.uint64)
    bucket = (_mixed(_mixed(u) + slice_) % np.uint64(buckets)).astype(np.int32)
    return _runs(bucket, buckets)


def _ask(buckets: int, hot: tuple[np.ndarray, np.ndarray]):
    def asked(part: dict[str, np.ndarray]) -> pa.RecordBatch:
        codes, k = _pairs_of(part)
        order, met, bounds = _dealt(codes, part["vocab"], buckets, hot)
        codes, k = codes[order], k[order]
        u, w = part["vocab"][codes // len(part["vocab"])], part["vocab"][codes % len(part["vocab"])]
        starts = np.r_[True, u[1:] != u[:-1]]
        starts[bounds[:-1]] = True
        first = np.flatnonzero(starts)
        runs = np.searchsorted(first, bounds)
        return _rows(_ASKED, bucket=met, part=np.repeat(part["part"], len(met)), us=(u[first], runs), runs=(np.diff(np.r_[first, len(u)]), runs), ws=(w, bounds), ks=(k, bounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _each(batches):
            yield asked(part)

    return run


def _in_order(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The order of pairs by context, then word: a sort of one number each, unless two words of a context share its bits."""
    ctx = np.unique(u)
    if len(ctx) < 1 << 20:
        key = (np.searchsorted(ctx, u) << 43) | (w >> 21) + (1 << 42)
        order = np.argsort(key)
        key, sorted_ = key[order], w[order]
        if not ((key[1:] == key[:-1]) & (sorted_[1:] != sorted_[:-1])).any():
            return order
    return np.lexsort((w, u))


def _cut_sums(ctx: np.ndarray, customers: np.ndarray, tables: np.ndarray, slices: np.ndarray) -> dict[str, np.ndarray]:
    """Customers and tables of this bucket's slices of contexts that are cut."""
    cut = slices > 1
    return {"cut_u": ctx[cut], "cut_c": customers[cut].astype(np.int64), "cut_t": tables[cut].astype(np.int64)}


def _add_up(hot: tuple[np.ndarray, np.ndarray]):
    """One bucket's pairs, contexts and answers, with a table for each pair that is seated."""

    def run(asked: pa.Table) -> pa.Table:
        runs, sizes = _flat(asked, "runs"), _lengths(asked, "ws")
        u, w, k = np.repeat(_flat(asked, "us"), runs), _flat(asked, "ws"), _flat(asked, "ks").astype(np.int64)
        part, place = np.repeat(_flat(asked, "part"), sizes), (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        order = _in_order(u, w)
        u, w, k, part, place = u[order], w[order], k[order], part[order], place[order]
        first = np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (w[1:] != w[:-1])])
        n_parts = np.diff(np.r_[first, len(u)])
        of = np.repeat(np.arange(len(first)), n_parts)
        c, pu, pw = np.add.reduceat(k, first), u[first], w[first]
        seated, single = c >= 2, (c[of] == 1) & (k == 0)
        starts = np.r_[True, pu[1:] != pu[:-1]]
        ctx, at = pu[starts], np.cumsum(starts) - 1
        ctx_c, has = np.bincount(at, weights=c, minlength=len(ctx)).astype(np.int64), np.bincount(at, weights=seated, minlength=len(ctx)) > 0
        slices = _slices(ctx, hot)
        has |= slices > 1  # a slice counts among its context's tables, whether or not it seats a pair
        hist_c, hist_n = np.unique(ctx_c[~has & (ctx_c > 0)], return_counts=True)
        tables = ctx_c - np.bincount(at[seated], weights=c[seated] - 1, minlength=len(ctx))
        return pa.Table.from_batches([_rows(
            _PAIRS, bucket=[asked["bucket"][0].as_py()], u=pu[seated], w=pw[seated], c=c[seated], ctx=ctx[has], ctx_c=ctx_c[has], slices=slices[has], hist_c=hist_c, hist_n=hist_n,
            t=np.ones(seated.sum()), past=[], **_cut_sums(ctx[has], ctx_c[has], tables[has], slices[has]), seated=[c[seated].sum()], twos=[(c == 2).sum()],
            n_parts=n_parts[seated], parts=part[seated[of]], places=place[seated[of]], one_parts=part[single], one_places=place[single],
        )])

    return run


def _needs(buckets: int):
    """The words of a bucket's pairs, by the bucket of the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            words = np.unique(row["w"])
            order, met, bounds = _by_word(words, buckets)
            yield _rows(_NEEDED, of=met, bucket=np.repeat(row["bucket"], len(met)), h=(words[order], bounds))

    return run


# Seating


def _stirling(d: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(n, m) of discount d, up to ``EXACT``."""
    s = np.full((EXACT + 1, EXACT + 1), -np.inf)
    s[1, 1] = 0.0
    for n in range(1, EXACT):
        m = np.arange(1, n + 2)
        with np.errstate(divide="ignore"):
            s[n + 1, m] = np.logaddexp(s[n, m - 1], s[n, m] + np.log(np.maximum(n - m * d, 0)))
    return s


def seat(c: np.ndarray, rest: np.ndarray, p: np.ndarray, d: float, theta: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with ``c`` customers, in restaurants with ``rest`` tables of other dishes, of probability ``p`` in the parent."""
    t, table = np.ones(len(c), np.int64), _stirling(d)
    for n in np.unique(c[(c >= 2) & (c <= EXACT)]):
        rows = np.flatnonzero(c == n)
        m = np.arange(1, n + 1)
        opened = np.cumsum(np.log(theta + d * (rest[rows, None] + m - 1)), axis=1)
        weight = table[n, m] + m * np.log(p[rows, None]) + opened
        upto = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
        t[rows] = 1 + (upto < rng.random(len(rows))[:, None] * upto[:, -1:]).sum(axis=1)
    rows, seated = np.flatnonzero(c > EXACT), 1
    while len(rows):
        block = np.minimum(max(1, seated // 16), c[rows] - seated)
        new = (theta + d * (rest[rows] + t[rows])) * p[rows]
        t[rows] += rng.binomial(block, new / (new + seated - d * t[rows]))
        seated += max(1, seated // 16)
        rows = rows[c[rows] > seated]
    return t


def _lgamma(x: np.ndarray) -> np.ndarray:
    y, down = x + 8, np.zeros_like(x)
    for k in range(8):
        down += np.log(x + k)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) - down


def fit(customers: np.ndarray, tables: np.ndarray, n: np.ndarray, d: float) -> np.ndarray:
    """Log likelihood of restaurants' seating under each concentration of ``GRID``."""
    c, t = customers.astype(float), tables.astype(float)
    return np.array([(n * (_lgamma(g / d + t) - math.lgamma(g / d) - _lgamma(g + c) + math.lgamma(g))).sum() for g in GRID])


def _drawn(fits: np.ndarray, rng: np.random.Generator) -> float:
    return float(GRID[np.argmax(fits + rng.gumbel(size=len(GRID)))])


def _whole(seats: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts cut in slices, with their customers and tables in all slices: a row for each, at most ``MOST_HOT``."""
    cut = seats.select(F.explode(F.arrays_zip("cut_u", "cut_c", "cut_t")).alias("z"))
    rows = cut.groupBy(F.col("z.cut_u").alias("u")).agg(F.sum("z.cut_c").alias("c"), F.sum("z.cut_t").alias("t")).collect()
    rows.sort(key=lambda r: r.u)
    return tuple(np.array([r[k] for r in rows], np.int64) for k in range(3))


def _tell_parents(fresh: float, all_: float):
    """What a bucket's words have for probabilities in the parent, to each bucket of contexts that needs them."""

    def run(needed: pa.Table, state: pa.Table) -> pa.Table:
        if not needed.num_rows:
            return _no_rows(_PARENTS)
        h, bounds = _flat(needed, "h"), np.r_[0, np.cumsum(_lengths(needed, "h"))]
        p = (_flat(state, "a")[_place(_flat(state, "h"), h)] + fresh) / all_
        return pa.Table.from_batches([_rows(_PARENTS, bucket=_flat(needed, "bucket"), h=(h, bounds), p=(p, bounds))])

    return run


def _sweep(d: float, theta: float, sweep: int, keep: bool, whole: tuple[np.ndarray, np.ndarray, np.ndarray]):
    def run(seats: pa.Table, parents: pa.Table) -> pa.Table:
        if not seats.num_rows:
            return _no_rows(_SEATS)
        row = {name: _flat(seats, name) for name in ("bucket", "u", "w", "c", "ctx", "ctx_c", "slices", "hist_c", "hist_n", "t", "past")}
        u, w, c, t = row["u"], row["w"], row["c"], row["t"]
        p = _flat(parents, "p")[_place(_flat(parents, "h"), w)] if len(w) else np.empty(0)
        of = np.searchsorted(row["ctx"], u)
        tables = lambda t: row["ctx_c"] - np.bincount(of, weights=c - t, minlength=len(row["ctx"]))
        before, cut = tables(t).astype(np.int64), row["slices"] > 1
        before[cut] = whole[2][np.searchsorted(whole[0], row["ctx"][cut])]
        t = seat(c, before[of] - t, p, d, theta, np.random.default_rng([sweep, int(row["bucket"][0])]))
        after = tables(t)
        found = fit(row["ctx_c"][~cut], after[~cut], np.ones((~cut).sum()), d) + fit(row["hist_c"], row["hist_c"], row["hist_n"], d)
        row |= {"t": t, "past": np.r_[row["past"], t] if keep else row["past"]}
        return pa.Table.from_batches([_rows(_SEATS, **row, **_cut_sums(row["ctx"], row["ctx_c"], after, row["slices"]), fit=found)])

    return run


def _spared(buckets: int):
    """Customers that opened no table in the contexts, by the bucket of the word that they were served."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            words, at = np.unique(row["w"], return_inverse=True)
            order, met, bounds = _by_word(words, buckets)
            yield _rows(_SPARED, of=met, h=(words[order], bounds), e=(np.bincount(at, weights=row["c"] - row["t"], minlength=len(words))[order], bounds))

    return run


def _added(state: pa.Table, spared: pa.Table) -> np.ndarray:
    """What is spared of each word of a bucket's state, a column for each number that comes with a word."""
    h = _flat(spared, "h")
    at, n = _place(_flat(state, "h"), h), len(_flat(state, "h"))
    e = _flat(spared, "e").reshape(len(h), -1) if len(h) else np.zeros((0, 1), np.int64)
    return np.stack([np.bincount(at, weights=x, minlength=n).astype(np.int64) for x in e.T], axis=1)


def _first(d: float):
    """The parent's first state: a table for each known word, and all of its customers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            yield _rows(_STATE, of=row["of"], h=row["h"], c=row["c"], a=np.where(row["c"] > 0, row["c"] - d, 0), kept=[], customers=row["total"], tables=row["known"])

    return run


def _root(d: float, theta: float, tables: int, p: float, sweep: int, keep: bool):
    """One bucket's words in the parent: what the contexts' tables send, and the parent's own tables, drawn from it."""

    def run(state: pa.Table, spared: pa.Table) -> pa.Table:
        of, c = state["of"][0].as_py(), _flat(state, "c")
        sent = c - _added(state, spared)[:, 0]
        t = np.where(c > 0, seat(sent, np.full(len(c), max(tables - 1, 0)), np.full(len(c), p), d, theta, np.random.default_rng([sweep, of, 1])), 0)
        a = sent - d * t
        return pa.Table.from_batches([_rows(_STATE, of=[of], h=_flat(state, "h"), c=c, a=a, kept=np.r_[_flat(state, "kept"), a] if keep else _flat(state, "kept"), customers=[sent.sum()], tables=[t.sum()])])

    return run


# Answers and scores


def _answers(pairs: pa.Table, seats: pa.Table) -> pa.Table:
    """Pairs by the part that asked: their customers, and their tables in each kept sweep."""
    row = {name: _flat(pairs, name) for name in ("bucket", "c", "n_parts", "parts", "places", "one_parts", "one_places")}
    samples, ones = _flat(seats, "past").reshape(KEPT, -1).T, len(row["one_parts"])
    at, part = np.r_[np.repeat(np.arange(len(row["c"])), row["n_parts"]), np.full(ones, len(row["c"]))], np.r_[row["parts"], row["one_parts"]]
    if not len(part):
        return _no_rows(_TOLD)
    names = np.unique(part)
    order, met, bounds = _runs(np.searchsorted(names, part), len(names))
    at, place = at[order], np.r_[row["places"], row["one_places"]][order]
    c, t = np.r_[row["c"], 1][at], np.r_[samples, np.ones((1, KEPT), np.int64)][at]
    return pa.Table.from_batches([_rows(_TOLD, part=names[met], bucket=np.repeat(row["bucket"], len(met)), place=(place, bounds), pc=(c, bounds), pt=(t.ravel(), bounds * KEPT))])


def _spared_contexts(buckets: int):
    """Customers of a context that opened no table, in each kept sweep, by the bucket of the context's word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            of = np.searchsorted(row["ctx"], row["u"])
            spare = np.stack([np.bincount(of, weights=row["c"] - t, minlength=len(row["ctx"])) for t in row["past"].reshape(KEPT, -1)], axis=1)
            order, met, bounds = _by_word(row["ctx"], buckets)
            yield _rows(_SPARED, of=met, h=(row["ctx"][order], bounds), e=(spare[order].ravel(), bounds * KEPT))

    return run


def _summary(fresh: list[tuple[float, float]]):
    """What scores need of a bucket's words: counts, the parent's probabilities and what is spared in the word's own context, in each kept sweep."""

    def run(state: pa.Table, spared: pa.Table) -> pa.Table:
        c, kept = _flat(state, "c"), _flat(state, "kept").reshape(KEPT, -1)
        p = np.stack([(a + new) / all_ for a, (new, all_) in zip(kept, fresh, strict=True)], axis=1)
        e = np.broadcast_to(_added(state, spared), p.shape)
        return pa.Table.from_batches([_rows(_SUMMARY, of=[state["of"][0].as_py()], h=_flat(state, "h"), c=c, wp=p.ravel(), we=e.ravel())])

    return run


def predictive(c: np.ndarray, t: np.ndarray, customers: np.ndarray, tables: np.ndarray, p: np.ndarray, d: float, theta: float) -> np.ndarray:
    """Probability of a dish with ``c`` customers at ``t`` tables, in a restaurant of these totals, under ``p`` in the parent."""
    return np.where(customers > 0, (c - d * t + (theta + d * tables) * p) / (theta + customers), p)


def _scored(d: float, thetas: list[float], total: int, known: int, buckets: int, hot: tuple[np.ndarray, np.ndarray]):
    def run(rows: pa.Table) -> pa.Table:
        tokens, told, facts = (rows.filter(pc.is_valid(rows[x])) for x in ("vocab", "bucket", "of"))
        part = _with_ids({name: _flat(tokens, name) for name in ("sizes", "low", "high", "vocab", "held")})
        facts = facts.sort_by("of")
        order, _, _ = _by_word(part["vocab"], buckets)
        row = np.empty(len(order), np.int64)
        row[order] = np.arange(len(order))
        count, p_, spared = _flat(facts, "wc")[row], _flat(facts, "wp").reshape(-1, KEPT)[row].astype(float), _flat(facts, "we").reshape(-1, KEPT)[row]
        codes, mine = _pairs_of(part)
        u, w = codes // len(part["vocab"]), codes % len(part["vocab"])
        c, t = mine.astype(np.int64), np.repeat(mine[None].astype(np.int64), KEPT, axis=0)
        if told.num_rows:
            order, met, bounds = _dealt(codes, part["vocab"], buckets, hot)
            start = np.repeat(bounds[np.searchsorted(met, _flat(told, "bucket"))], _lengths(told, "place"))
            pair = order[start + _flat(told, "place")]
            c[pair] = _flat(told, "pc")
            t[:, pair] = _flat(told, "pt").reshape(-1, KEPT).T
        mean = np.zeros(len(codes))
        for s, theta in enumerate(thetas):
            mean += predictive(c, t[s], count[u], (count - spared[:, s])[u], p_[:, s][w], d, theta) / KEPT
        starts = np.r_[0, np.cumsum(part["sizes"])[:-1]]
        base = np.log10((count + 0.5) / (total + 0.5 * (known + 1)))
        per_doc = lambda x: np.add.reduceat(x, starts)
        return pa.table({
            "doc_id": pa.concat_arrays([x.flatten() for x in tokens["doc_ids"].chunks]), "held_out": pa.array(part["held"].astype(bool)), "n_tokens": pa.array(part["sizes"].astype(np.int64)),
            "n_known": pa.array(per_doc((count > 0).astype(np.int64)[part["ids"]])), "base_score": pa.array(per_doc(base[part["ids"]])),
            "score": pa.array(per_doc(np.log10(mean)[np.searchsorted(codes, _codes(part))])),
        })

    return run


def _discount(ones: int, twos: int) -> float:
    return min(0.95, max(0.05, ones / (ones + 2 * twos) if ones else 0.5))


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark, mark = docs.sparkSession, staged()
    at = staging_path(spark, "lm-parts")
    texts = documents(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    texts.mapInArrow(_split, _PARTS).write.options(**_LARGE).parquet(at)
    parts = spark.read.schema(_PARTS).parquet(at)
    sums = lambda df, *names: df.agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in names)).first()
    all_ = sums(parts, F.aggregate("sizes", F.lit(0).cast("long"), lambda x, y: x + y))[0]
    buckets = max(1, -(-all_ // BUCKET))
    least = max(SLICE + 1, -(-all_ // MOST_HOT))  # at most MOST_HOT words are as frequent
    counted = parts.select("low", "high", "held", "sizes", "vocab").mapInArrow(_counts(buckets), _COUNTED)
    words = stash(counted.groupBy("of").applyInArrow(_trimmed(_sums(least)), _WORDS), "lm-words", **_LARGE)
    total, known, w1, w2 = sums(words, "total", "known", "ones", "twos")
    large = [r.z for r in words.select(F.explode(F.arrays_zip("large", "large_n")).alias("z")).collect()]
    large.sort(key=lambda z: z.large)
    hot = np.array([z.large for z in large], np.int64), np.array([-(-z.large_n // SLICE) for z in large], np.int64)

    asked = parts.drop("doc_ids").mapInArrow(_ask(buckets, hot), _ASKED)
    pairs = stash(asked.groupBy("bucket").applyInArrow(_trimmed(_add_up(hot)), _PAIRS), "lm-pairs", **_LARGE)
    del asked, counted
    free_shuffles(spark)
    seated, twos = sums(pairs, "seated", "twos")
    d, d0, theta, theta0, p0 = _discount(total - seated, twos), _discount(w1, w2), 8.0, 8.0, 1.0 / (known + 1)

    state = words.select("of", "h", "c", "total", "known").mapInArrow(_first(d0), _STATE)
    seats = pairs.select(*(f.split(" ")[0] for f in _SEATED.split(", ")))
    needed = stash(pairs.select("bucket", "w").mapInArrow(_needs(buckets), _NEEDED), "lm-needed", **_LARGE)
    customers0, tables0, thetas, fresh = total, known, [], []
    opening = ((theta0 + d0 * tables0) * p0, theta0 + customers0)  # a new table's share, and all, in the parent
    whole = _whole(seats) if large else (np.empty(0, np.int64),) * 3
    for sweep in range(BURN_IN + KEPT):
        keep, rng = sweep >= BURN_IN, np.random.default_rng([sweep, 1 << 20])
        parents = needed.groupBy("of").cogroup(state.groupBy("of")).applyInArrow(_trimmed(_tell_parents(*opening)), _PARENTS)
        swept = seats.groupBy("bucket").cogroup(parents.groupBy("bucket")).applyInArrow(_trimmed(_sweep(d, theta, sweep, keep, whole)), _SEATS)
        seats = stash(swept, f"lm-seats-{sweep}", **_LARGE)
        whole = _whole(seats) if large else whole
        fits = {r.k: r.f for r in seats.select(F.posexplode("fit").alias("k", "f")).groupBy("k").agg(F.sum("f").alias("f")).collect()}  # a row for each of GRID
        spared = seats.select("w", "c", "t").mapInArrow(_spared(buckets), _SPARED)
        # What the contexts' tables send to the parent; its own tables are drawn from them.
        state = stash(state.groupBy("of").cogroup(spared.groupBy("of")).applyInArrow(_trimmed(_root(d0, theta0, tables0, p0, sweep, keep)), _STATE), f"lm-state-{sweep}", **_LARGE)
        customers0, tables0 = sums(state, "customers", "tables")
        opening = ((theta0 + d0 * tables0) * p0, theta0 + customers0)
        if keep:
            thetas.append(theta)
            fresh.append(opening)
        purge(spark, mark, keep=("lm-parts", "lm-pairs", "lm-needed", f"lm-seats-{sweep}", f"lm-state-{sweep}"))
        del parents, swept, spared
        free_shuffles(spark)
        theta = _drawn(np.array([fits.get(k, 0.0) for k in range(len(GRID))]) + fit(whole[1], whole[2], np.ones(len(whole[1])), d), rng)
        theta0 = _drawn(fit(np.array([customers0]), np.array([tables0]), np.ones(1), d0), rng)

    spare = seats.select("u", "c", "ctx", "past").mapInArrow(_spared_contexts(buckets), _SPARED)
    facts = stash(state.groupBy("of").cogroup(spare.groupBy("of")).applyInArrow(_trimmed(_summary(fresh)), _SUMMARY), "lm-facts", **_LARGE)
    asking = pairs.select("bucket", "c", "n_parts", "parts", "places", "one_parts", "one_places")
    told = stash(asking.groupBy("bucket").cogroup(seats.select("bucket", "past").groupBy("bucket")).applyInArrow(_trimmed(_answers), _TOLD), "lm-told", **_LARGE)
    del asking, spare, seats, pairs, state
    purge(spark, mark, keep=("lm-parts", "lm-facts", "lm-told"))
    free_shuffles(spark)
    lots = []
    for lot in range(LOTS):
        # A range of parts, so that the others' row groups are passed over.
        some = (F.col("part") >= _LAST * lot // LOTS) & (F.col("part") < _LAST * (lot + 1) // LOTS)
        mine = parts.where(some)
        by_word = mine.select("part", "vocab").mapInArrow(_ask_words(buckets), _WANTED).groupBy("of").cogroup(facts.groupBy("of")).applyInArrow(_trimmed(_tell_words), _FACTS)
        every = mine.unionByName(told.where(some), allowMissingColumns=True).unionByName(by_word, allowMissingColumns=True)
        lots.append(stash(every.groupBy("part").applyInArrow(_trimmed(_scored(d, thetas, total, known, buckets, hot)), _SCORES), "lm-scores"))
        del by_word, every
        free_shuffles(spark)
    scored = reduce(DataFrame.unionByName, lots)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
