import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from ledgerline.llm import packing, token_counts

SP, BPE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", " ", "a", "Hello world", "two  spaces", "line\nend\n\nmore", "日本語 text 梦", "émoji 🙂 x", "▁mark", "<s> tag", "x" * 300, "a\tb", " lead", "the of and to in " * 40]


@pytest.fixture(scope="module")
def unigram():
    tok = Tokenizer(models.Unigram(token_counts.load_pieces(SP), 0, True))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")
    return tok


def test_counts_equal_the_tokenizer(unigram):
    counter = token_counts.Counter(token_counts.load_pieces(SP))
    r = random.Random(3)
    more = ["".join(r.choice("aeinorst heTHE.,\n é") for _ in range(r.randrange(80))) for _ in range(400)]
    for t in TEXTS + more:
        assert counter.count(t) == len(unigram.encode(t, add_special_tokens=False).ids), t


def test_counts_of_documents(spark, unigram, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = token_counts.with_counts(docs, token_counts.load_pieces(SP)).collect()
    for r in got[:60]:
        assert r.n_tokens == len(unigram.encode(r.text, add_special_tokens=False).ids)
    none = spark.createDataFrame([(1, None, 5)], "doc_id long, text string, n long")
    assert token_counts.with_counts(none, token_counts.load_pieces(SP)).first().n_tokens == 0


def test_small_cache_gives_the_same(monkeypatch):
    pieces = token_counts.load_pieces(SP)
    want = [token_counts.Counter(pieces).count(t) for t in TEXTS]
    monkeypatch.setattr(token_counts, "REMEMBERED", 2)
    assert [token_counts.Counter(pieces).count(t) for t in TEXTS] == want


def test_ids_equal_the_tokenizer(sf):
    import pyarrow.parquet as pq

    tok = Tokenizer.from_file(BPE)
    texts = pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist()[:80] + TEXTS
    texts += ["a<|endoftext|>b C<|startoftext|>", "Ⅷ É é don't I'LL x y <|ENDOFTEXT|>", "ß ſ İ ΑΣ", "\t\n \r\x0b\x0c"]
    for t, ids in zip(texts, packing.token_bytes(pa.array(texts), BPE), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_best_fit_and_bounds():
    r = random.Random(4)
    for _ in range(60):
        sizes = np.array(sorted((r.randint(1, 100) for _ in range(r.randrange(1, 60))), reverse=True))
        where, offset, fill = packing.best_fit_decreasing(sizes, 100)
        assert (fill <= 100).all() and fill.sum() == sizes.sum()
        for b in range(len(fill)):
            spans = sorted((offset[k], sizes[k]) for k in np.flatnonzero(where == b))
            assert [s for s, _ in spans] == list(np.cumsum([0, *[n for _, n in spans]])[:-1])
        assert packing.lower_bound(sizes, 100) <= len(fill)
    assert packing.lower_bound(np.array([60, 60, 60]), 100) == 3
    assert packing.lower_bound(np.array([51, 51, 34, 34, 34]), 100) == 3


def test_pack_documents(spark, sf):
    tok = Tokenizer.from_file(BPE)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-2, ""), (None, "x")], "doc_id long, text string"))
    texts = docs.collect()
    for part_pieces in (packing.PART_PIECES, 60):  # the second makes partitions exchange documents
        packed = packing.pack(packing.pieces(docs, BPE), part_pieces=part_pieces).collect()
        want = []
        for d in texts:
            ids = np.array([*tok.encode(d.text or "", add_special_tokens=False).ids, 1], "<u4")
            want += [(str(d.doc_id), n, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for n, at in enumerate(range(0, len(ids), 4096))]
        assert sorted((str(p.doc_id), p.piece, p.start, p.length, p.ids_crc32) for p in packed) == sorted(want)
        by = {}
        for p in packed:
            by.setdefault(p.sequence_id, []).append((p.offset, p.length))
        for spans in by.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at <= 4096
        least = packing.lower_bound(np.array([w[3] for w in want]))
        assert least <= len(by) <= least + (3 if part_pieces == 60 else 1)
    assert packing.pack(packing.pieces(docs.limit(0), BPE)).count() == 0


def test_packing_keeps_ids_and_spreads_copies(spark):
    """Null and large ids in one partition; 10**5 equal rows are dealt over several partitions."""
    ids = [2**60 + 1, 2**60 + 3, None, 5]
    docs = spark.createDataFrame([(i, "a b", 1, 2) for i in ids], "doc_id long, text string, bin int, gap int")
    assert sorted(str(p.doc_id) for p in packing.pack_documents(docs, BPE).collect()) == sorted(map(str, ids))
    row = spark.range(100_000).selectExpr("cast(7 as long) doc_id", "0 piece", "0L start", "1000L length", "3L ids_crc32")
    packed = packing.pack(row, part_pieces=20_000)
    used = packed.groupBy("sequence_id").agg(F.count("*").alias("n"), F.max("offset").alias("top")).agg(F.max("n"), F.sum("n"), F.max("top"), F.count("*")).first()
    assert used[0] == 4 and used[1] == 100_000 and used[2] == 3000 and 25_000 <= used[3] <= 25_005
    parts = packed.groupBy(F.shiftright("sequence_id", 24)).count().agg(F.max("count"), F.count("*")).first()
    assert parts[1] >= 5 and parts[0] < 22_000


def test_a_round_that_saves_nothing_is_not_used(spark, monkeypatch):
    """Where dealing anew makes more bins than it dissolved, the pieces keep their earlier places."""
    rows = [(k, 0, 0, 30 if k % 2 else 40, k) for k in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    plain, tables = packing._pack, []

    def by_round(capacity):
        made = plain(capacity)
        if sum(1 for label, _ in tables if label.startswith("pack-0")) == 0:
            return made

        def alone(key, rows):  # later rounds put each piece into a bin of its own
            out = made(key, rows)
            n = pa.array(range(len(out)), pa.int64())
            out = out.set_column(out.schema.get_field_index("bin"), "bin", n)
            return out.set_column(out.schema.get_field_index("offset"), "offset", pa.array([0] * len(out), pa.int64()))

        return alone

    def kept(df, label, stash=packing.stash):
        tables.append((label, stash(df, label)))
        return tables[-1][1]

    monkeypatch.setattr(packing, "_pack", by_round)
    monkeypatch.setattr(packing, "stash", kept)
    after = packing.pack(table, 100, part_pieces=10)
    rounds = {label: t for label, t in tables if label[-1].isdigit()}
    first = rounds["pack-0"].select("part", "bin").distinct().count()
    assert len(rounds) == 2 and rounds["pack-1"].select("part", "bin").distinct().count() > rounds["pack-0"].where("released").select("part", "bin").distinct().count()
    assert after.count() == 40 and after.select("sequence_id").distinct().count() == first
