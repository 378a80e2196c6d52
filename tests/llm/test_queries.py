"""The registered queries over tables with nulls, repeated rows, very long texts and clashing columns, and over empty ones."""

import hashlib
import re
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerline.llm import queries

LONG = "".join(f"Word{k % 977} and,\n" for k in range(20_000))
TEXTS = [None, "", " \n\t ", "one", LONG, LONG, "mail a@b.co or 1.2.3.4", "Straße ﬁne 🙂 " * 40, "x" * 5000, "same text", "same text"]
#: Names that the operators use inside.
CLASHING = ["n_tokens", "size", "slot", "shard", "fp", "label", "row", "n", "taken", "wide", "bits", "spans", "copy", "key", "tie", "part", "to", "k"]


def documents(spark):
    rows = [(k, t, "en", None if k % 4 == 0 else f"s{k % 3}", len(t or "")) for k, t in enumerate(TEXTS)]
    rows += [rows[3], rows[3], (2**60 + 1, "large id", "en", "s1", 8), (2**60 + 3, "large id", "en", "s1", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.fixture(scope="module")
def edge(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("edge"))
    documents(spark).write.parquet(f"{at}/documents.parquet")
    pages = spark.createDataFrame([(1, "http://a/x y", "<p>é</p>"), (2, None, None), (2, None, None), (3, "u", "<p>é</p>"), (4, "u", "y" * 3_000_000)], "page_id long, url string, html string")
    pages.withColumns({c: F.lit("clash") for c in ("digest", "block", "value", "record_id")}).write.parquet(f"{at}/pages.parquet")
    turns = spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", "yes"), (1, 1, "assistant", "yes"), (None, 0, None, "x"), (2, 0, "assistant", "z" * 100_000)], "conv_id long, turn long, role string, text string")
    turns.withColumns({c: F.lit("clash") for c in ("example", "rendered", "body", "mask")}).write.parquet(f"{at}/conversations.parquet")
    stamps = spark.createDataFrame([(1, None, None, None), (2, "s", "UTC", "2024-01-01"), (2, "s", "UTC", "2024-01-01"), (3, "s", "UTC", "x" * 100_000), (4, None, "UTC", "01/02/2024")], "stamp_id long, source string, zone string, raw string")
    stamps.withColumns({c: F.lit("clash") for c in ("wall", "rule", "kind", "bin")}).write.parquet(f"{at}/stamps.parquet")
    return at


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory, edge):
    at = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "pages", "conversations", "stamps"):
        spark.read.parquet(f"{edge}/{t}.parquet").limit(0).write.parquet(f"{at}/{t}.parquet")
    return at


@pytest.mark.parametrize("name", sorted(q for q in queries.queries() if q.startswith("op")))
def test_edges(spark, edge, empty, name):
    query = queries.queries()[name]
    rows = query(spark, edge).collect()
    n = {"op3_warc": 5, "op4_chat_formatting": 4, "op11_timestamps": 5, "op12_spelling_variants": 0}.get(name, len(TEXTS) + 4)
    if name == "op5_packing":
        n += sum(r.piece > 0 for r in rows)
    assert len(rows) == n
    key = {"op3_warc": "page_id", "op4_chat_formatting": "conv_id", "op11_timestamps": "stamp_id", "op12_spelling_variants": "word"}.get(name, "doc_id")
    if key == "doc_id":
        assert {r.doc_id for r in rows} == {*range(len(TEXTS)), 2**60 + 1, 2**60 + 3}
    again = query(spark, edge).drop("sequence_id", "offset").collect()
    left = {"sequence_id", "offset"}
    plain = lambda rs: sorted(str(sorted((k, v) for k, v in r.asDict().items() if k not in left)) for r in rs)
    assert plain(rows) == plain(again)
    assert query(spark, empty).count() == (1 if name == "op4_chat_formatting" else 0)  # the probe conversation


def test_contract_columns(spark, edge):
    """Sizes, checksums and tokens of every document, from plain Python."""
    text = {k: t or "" for k, t in enumerate(TEXTS)} | {2**60 + 1: "large id", 2**60 + 3: "large id"}
    for r in queries.op8_sharding(spark, edge).collect():
        raw = text[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "bytes") and 0 <= r.shard < 24
    for r in queries.op9_mixing(spark, edge).collect():
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", text[r.doc_id])) and r.taken in (0, r["size"], 2 * r["size"])
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    for r in queries.op5_packing(spark, edge).collect():
        pieces.setdefault(r.doc_id, set()).add((r.piece, r.start, r.length))
    for k, t in text.items():
        n = len(tok.encode(t, add_special_tokens=False).ids) + 1
        assert pieces[k] == {(p, at, min(4096, n - at)) for p, at in enumerate(range(0, n, 4096))}
    ids = sorted(text)
    for r in queries.op6_fingerprints(spark, edge).collect():
        if r.doc_id == 3:
            continue  # three equal rows: each other's successors
        t, nxt = text[r.doc_id], text[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        half = len(t) // 2
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()


def test_sql_twins(spark, sf):
    """Every query of the package with SQL gives its rows."""
    from pathlib import Path

    import duckdb

    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    for name, sql in queries.oracle_sql().items():
        found = con.execute(sql)
        names = [d[0] for d in found.description]
        want = sorted(str([str(v) for _, v in sorted(zip(names, r, strict=True))]) for r in found.fetchall())
        got = sorted(str([str(v) for _, v in sorted(r.asDict().items())]) for r in queries.queries()[name](spark, sf).collect())
        assert got == want, name
