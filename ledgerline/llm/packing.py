"""Best-fit packing with certified bounds.

Documents become token pieces of at most ``capacity`` tokens. Pieces are dealt
over partitions of a bounded number of pieces; each partition is packed by
best-fit decreasing, and dual-feasible functions give a lower bound of the bins
that its pieces need. A partition over its bound keeps its full bins and exchanges
the documents of the rest; one that meets its bound exchanges those of its loosest
bins, for bounds of parts add up to more than the bound of the whole. What is
exchanged is dealt anew over fewer partitions and packed again, as long as a
round saves a bin: until all bins together meet the bound of all pieces, one
partition is left, or a round saves nothing. Such a round is not used; its
pieces keep their earlier places. Pieces are dealt by a row number that is stored
with them, so rows that repeat spread like others.

Defined results: a null or empty text is the end token alone, one piece of one
token; repeated rows are packed as often as they occur; ties in length are
ordered by doc_id (null last) and piece; rows with a null doc_id are packed like
others; an empty table gives no pieces; extra columns are not read; only texts
over the capacity are cut, every other document stays whole.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, trim_memory

CAPACITY = 4096
END_ID = 1
REMEMBERED = 450_000
REMEMBERED_CHARS = 64
#: Bytes of text looked up together.
AT_ONCE = 4 << 20
#: Pieces of a packing partition, at most about: bounds the memory of a task.
PART_PIECES = 50_000
#: Bins of a partition at its bound are exchanged if they are filled less than this.
LOOSE = 0.98

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Special strings of the tokenizer file are matched as written: texts with this mark keep their case.
SPECIAL = "<|"


#: Lower-case words of these letters are one token run each, and signs after them another.
PLAIN = re.compile(r"^(?:([a-zß-öø-ÿ]+)([!-/:-@\[-`{-~]*)|.*)$", re.MULTILINE)
WORD_END = "</w>"


class Words:
    """Token ids of words, as bytes, for one tokenizer file.

    Two generations of at most ``remembered`` words each: when the younger is full it
    becomes the older, and words found there are taken up again. Plain words are
    coded many at a time; their last tokens, which carry the word end, show where
    one stops. Other words are coded one by one.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # Plain words need neither normalising nor splitting other than at spaces.
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        parts = json.loads(self.tokenizer.to_str())
        #: Whether the file lower-cases, drops white space and marks word ends; else whole texts are coded.
        self.by_words = parts["model"].get("end_of_word_suffix") == WORD_END and '"Lowercase"' in json.dumps(parts["normalizer"])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.signs: dict[str, bytes] = {}

    def each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def plain(self, words: list[str]) -> Iterator[bytes]:
        step = 512
        some = [words[at : at + step] for at in range(0, len(words), step)]
        for own, e in zip(some, self.model.encode_batch_fast([" ".join(x) for x in some], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(cuts) != len(own):
                yield from self.each(own)
                continue
            whole, start = ids.tobytes(), 0
            for cut in cuts:
                yield whole[4 * start : 4 * cut]
                start = cut

    def code(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words not met before."""
        shapes = PLAIN.findall("\n".join(words))
        bare = list({core for core, _ in shapes if core})
        signs = list({sign for core, sign in shapes if core}.difference(self.signs))
        if len(self.signs) > 10_000:
            self.signs, signs = {}, list({sign for core, sign in shapes if core})
        self.signs |= zip(signs, self.each(signs), strict=True)
        ids = {c: self.young.get(c) or self.old.get(c) for c in bare}  # often met without its signs
        fresh = [c for c, coded in ids.items() if coded is None]
        ids.update(zip(fresh, self.plain(fresh), strict=True))
        odd = [k for k, (core, _) in enumerate(shapes) if not core]
        other = dict(zip(odd, self.each([words[k] for k in odd]), strict=True)) if odd else {}
        return {w: ids[core] + self.signs[sign] if core else other[k] for k, (w, (core, sign)) in enumerate(zip(words, shapes, strict=True))}

    def ids(self, words: list[str]) -> list[bytes]:
        """The ids of each of some different words."""
        table = dict(zip(words, map(self.young.get, words), strict=True))
        missing = [w for w, ids in table.items() if ids is None]
        if self.old:
            again = {w: self.old[w] for w in missing if w in self.old}
            self.young.update(again)
            table.update(again)
            missing = [w for w in missing if w not in again]
        if missing:
            new = self.code(missing)
            table.update(new)
            self.young.update(new if max(map(len, missing)) <= REMEMBERED_CHARS else {w: ids for w, ids in new.items() if len(w) <= REMEMBERED_CHARS})
            if len(self.young) > self.remembered:
                self.old, self.young = self.young, {}
        return list(table.values())

    def texts(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text.

        A tokenizer of whole words never joins characters across ASCII white space,
        so a text's ids are those of its words, one after the other. Arrow splits
        the texts and numbers their words; each different word is looked up once.
        """
        low = pc.if_else(pc.match_substring(texts, SPECIAL), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(low)
        coded = split.flatten().dictionary_encode()
        words = self.ids(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, words), np.int32, len(words)) // 4
        every = np.frombuffer(b"".join(words), "<u4")
        at = coded.indices.to_numpy()
        size = sizes[at]
        ends = np.zeros(len(at) + 1, np.int32)
        np.cumsum(size, out=ends[1:])
        first = np.cumsum(sizes, dtype=np.int32) - sizes
        tokens = every[np.repeat(first[at] - ends[:-1], size) + np.arange(ends[-1], dtype=np.int32)]
        cuts = ends[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        for s, e in zip(cuts, cuts[1:], strict=False):
            yield tokens[s:e].tobytes()


_WORDS: dict[tuple[str, int], Words] = {}


def token_bytes(texts: pa.Array, path: str, remembered: int = REMEMBERED) -> Iterator[bytes]:
    """Little-endian 32-bit ids of each text (none null), a few megabytes of text at a time."""
    words = _WORDS.get((path, remembered)) or _WORDS.setdefault((path, remembered), Words(path, remembered))
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        done = sizes[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(sizes, done + AT_ONCE, "right")))
        some = texts.slice(at, stop - at)
        yield from words.texts(some) if words.by_words else words.each(some.to_pylist())
        at = stop


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """The token pieces of every document; with_ids adds their ids (array<int>).

    ``remembered`` words (twice as many at most, about 200 bytes each) are kept by a
    Python worker: fewer cost time alone.
    """
    last = int(end_id).to_bytes(4, "little")
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            texts = pc.fill_null(batch.column("text"), "")
            rows: list[tuple] = []
            for doc_id, coded in zip(ids, token_bytes(texts, path, remembered), strict=True):
                coded += last
                for n, at in enumerate(range(0, len(coded), 4 * capacity)):
                    part = coded[at : at + 4 * capacity]
                    rows.append((doc_id, n, at // 4, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, "<u4").astype(np.int32)] if with_ids else [])))
            if not rows:
                continue
            cols = list(zip(*rows, strict=True))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=False)], names[: len(cols)])
        trim_memory()

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each piece, and the fill of each bin. Lengths come in descending order."""
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    fill: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: some bin has room r
    for k, size in enumerate(lengths.tolist()):
        fitting = open_rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        where[k], offset[k] = b, fill[b]
        fill[b] += size
        left = room - size
        if left:
            by_room[left].append(b)
            open_rooms |= 1 << left
    return where, offset, np.array(fill, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY, counts: np.ndarray | None = None) -> int:
    """Bins that the lengths (each ``counts`` times) need at least: the best of three families of dual-feasible functions."""
    if not len(lengths):
        return 0
    n = np.bincount(lengths, counts, minlength=capacity + 1).round().astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    bound = -(-int((n * x).sum()) // capacity)
    # Large counts whole, small not at all: f(x) = C over C - e, 0 under e, else x.
    e = np.arange(0, capacity // 2 + 1)
    count, weight = np.cumsum(n), np.cumsum(n * x)
    large = count[-1] - count[capacity - e]
    middle = weight[capacity - e] - np.where(e > 0, weight[np.maximum(e - 1, 0)], 0)
    bound = max(bound, int(np.max(large - (-middle // capacity))))
    # Rounding to multiples of 1 / k.
    for k in range(1, 33):
        scaled = (k + 1) * x
        bound = max(bound, -(-int((n * np.where(scaled % capacity == 0, k * x, scaled // capacity * capacity)).sum()) // (k * capacity)))
    return bound


def _pack(capacity: int):
    order = [("length", "descending"), *[(c, "ascending") for c in ("doc_id", "piece", "start", "ids_crc32", "row")]]

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, sort_keys=order, null_placement="at_end"))
        lengths = rows["length"].to_numpy()
        where, offset, fill = best_fit_decreasing(lengths, capacity)
        gap = len(fill) - lower_bound(lengths, capacity)
        released = (fill < (capacity if gap > 0 else LOOSE * capacity))[where]
        for name, values in (("bin", where), ("offset", offset), ("gap", np.full(len(where), gap)), ("released", released)):
            rows = rows.append_column(name, pa.array(values))
        return rows

    return pack


def pack(table: DataFrame, capacity: int = CAPACITY, part_pieces: int = PART_PIECES) -> DataFrame:
    """``table`` (PIECES) with sequence_id, offset, and the certificate of its partition's last round.

    ``gap`` is the number of bins over the lower bound in that round: 0 where the
    number of sequences is proven least for the partition's pieces.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    left = stash(table.select(*names, F.monotonically_increasing_id().alias("row")), "pack-pieces")
    sizes = left.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``capacity`` rows
    bound = lower_bound(np.array([r.length for r in sizes]), capacity, np.array([r.n for r in sizes], np.int64)) if sizes else 0
    schema = PIECES + ", row long, part long, bin long, offset long, gap long, released boolean"
    finished: list[DataFrame] = []
    earlier: DataFrame | None = None
    n, kept, bins, round_no = sum(r.n for r in sizes), 0, 0, 0
    while True:
        parts = max(1, -(-n // part_pieces))
        dealt = left.withColumn("part", F.pmod(F.xxhash64("row", F.lit(round_no)), F.lit(parts)))
        packed = stash(dealt.groupBy("part").applyInArrow(_pack(capacity), schema), f"pack-{round_no}")
        state = packed.groupBy("part").agg(F.sum(F.col("released").cast("long")).alias("n"), F.countDistinct(F.when(F.col("released"), F.col("bin"))).alias("bins"), F.countDistinct("bin").alias("made"))
        n, loose, made = state.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "bins", "made")]).first()
        if earlier is not None and made >= bins:  # nothing saved: the pieces stay where the round before put them
            finished[-1] = earlier
            break
        numbered = packed.withColumn("sequence_id", F.lit(round_no).cast("long") * F.lit(1 << 48) + F.col("part") * F.lit(1 << 24) + F.col("bin"))
        if kept + made <= bound or parts == 1 or not loose:
            finished.append(numbered)
            break
        finished.append(numbered.where(~F.col("released")))
        kept, bins, earlier, round_no = kept + made - loose, loose, numbered, round_no + 1
        left = packed.where("released").select(*names, "row")
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    return out.select(*names, "sequence_id", "offset", "gap")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, remembered: int = REMEMBERED) -> DataFrame:
    """Tokenize, cut and pack ``docs``; one row for each piece."""
    return pack(pieces(docs, path, capacity, remembered=remembered), capacity)
