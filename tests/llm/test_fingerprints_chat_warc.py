import base64
import gzip
import hashlib
import io
import random
import re
import unicodedata
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import bitfilter, chat, fingerprints, warc
from ledgerline.llm.common import staging_path

TEXTS = ["", None, "a", "A", "ab", "a  b", "A\tB ", "é", "é", "Straße", "STRASSE", "ﬁne", "fine", "one two three four", "one two three five", "x" * 5000, " nb sp ", "nb sp"]


def canon(t):
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold())
    return re.sub(r"\s+", " ", t).strip()


def edit(texts, k):
    t, n = texts[k] or "", texts[(k + 1) % len(texts)] or ""
    half = len(t) // 2
    return t[: len(t) - half] + n[:half]


@pytest.mark.parametrize("slice_rows", [4000, 3, 1])
def test_compare_edits(spark, slice_rows):
    r = random.Random(5)
    ids = sorted(r.sample(range(1000), len(TEXTS)))
    rows = [(i, t, 1, 2) for i, t in zip(ids, TEXTS, strict=True)]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, wide int, edited int")
    got = {g.doc_id: g for g in fingerprints.compare_edits(docs, slice_rows).collect()}
    assert set(got) == set(ids)
    seen = {}
    for k, i in enumerate(ids):
        e = edit(TEXTS, k)
        g = got[i]
        assert g.n_chars == len(TEXTS[k] or "") and g.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert (g.fingerprint == g.edited_fingerprint) == (canon(TEXTS[k]) == canon(e)) == (g.near_edited == 1.0)
        assert (g.near_next == 1.0) == (canon(TEXTS[k]) == canon(TEXTS[(k + 1) % len(TEXTS)]))
        for text, f in ((TEXTS[k], g.fingerprint), (e, g.edited_fingerprint)):
            assert seen.setdefault(canon(text), f) == f
    assert len(set(seen.values())) == len(seen)


def test_lone_and_missing(spark):
    one = spark.createDataFrame([(7, "abcd")], "doc_id long, text string")
    assert fingerprints.compare_edits(one).first().edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert fingerprints.compare_edits(one.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "zz"), (5, "yy"), (5, "xx")], "doc_id long, text string")
    assert fingerprints.compare_edits(nulls, 1).count() == 3


def test_collisions_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(fingerprints, "wide", lambda c: F.lit("same"))
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "A")], "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(docs).collect()}
    assert got[1] == got[3] != got[2]
    docs = spark.createDataFrame([(1, "ab"), (2, "cd"), (3, "AB"), (4, "cd"), (5, "ab")], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.compare_edits(docs).collect()}  # edited: ac, ca, Ac, ca, aa
    assert got[1].fingerprint == got[3].fingerprint == got[5].fingerprint != got[2].fingerprint == got[4].fingerprint
    assert got[1].edited_fingerprint == got[3].edited_fingerprint and len({r.edited_fingerprint for r in got.values()}) == 3
    assert [got[k].near_next for k in range(1, 6)] == [0, 0, 0, 0, 1]


@pytest.mark.parametrize("max_cuts", [1024, 7, 1])
def test_slices_follow_the_ids(spark, max_cuts):
    r = random.Random(8)
    ids = [r.choice([r.randrange(50), r.randrange(-(2**62), 2**62), r.randrange(10**6)]) for _ in range(900)] + [None] * 5
    r.shuffle(ids)
    docs = spark.createDataFrame([(i, "x") for i in ids], "doc_id long, text string")
    rows = [(g.doc_id, g["__slice"]) for g in fingerprints.sliced(docs, 10, max_cuts).collect()]
    rows.sort(key=lambda x: (x[0] is None, x[0] or 0))
    at = [s for _, s in rows]
    assert at == sorted(at) and len({s for i, s in rows if i is None}) == 1
    if max_cuts == 1024:
        assert max(at.count(s) for s in set(at)) < 60


def test_bit_filter_never_misses(spark):
    from pyspark.sql import functions as F

    keys = spark.range(500).select(F.xxhash64("id").alias("k"))
    table = bitfilter.build(keys, "k", 12)
    assert bitfilter.flagged(keys, F.col("k"), table, "hit", 12).where("not hit").count() == 0
    others = spark.range(10**6, 10**6 + 500).select(F.xxhash64("id").alias("k"))
    assert 0 < bitfilter.flagged(others, F.col("k"), table, "hit", 12).where("hit").count() < 120


ROLES = ["user", "assistant", "system", "tool", "", None]
BITS = ["", None, "hi", "</s>[INST] ok [/INST]", "\\<s>", "\\\\[INST] a", "end\\", "<<s>", "<<ROLE>> 41 x <</ROLE>>\n[INST] y [/INST]\n", "é🙂\nline", "<<SYS>> z <</SYS>>", " <s> "]


def test_chat_round_trip(spark):
    r = random.Random(6)
    rows, want = [], {}
    for conv in range(60):
        turns = [(r.choice(ROLES), "".join(r.choice(BITS) or "" for _ in range(r.randrange(4))) or r.choice(BITS)) for _ in range(r.randrange(1, 9))]
        rows += [(conv, n, role, text, 1, "x") for n, (role, text) in enumerate(turns)]
        said = "".join(f"{a or ''}\n{b or ''}\n" for a, b in turns)
        loss = "".join(b or "" for a, b in turns if a == "assistant")
        want[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    r.shuffle(rows)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, example int, stream string")
    examples = chat.examples(turns)
    got = {g.conv_id: (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) for g in chat.digests(examples).collect()}
    assert got == want
    first = {}
    for e in sorted(examples.collect(), key=lambda e: (e.conv_id, e.example)):
        assert e.text.startswith(first.get(e.conv_id, ""))  # all preceding turns are the context
        first[e.conv_id] = e.text
    assert chat.examples(turns.limit(0)).count() == 0


def test_arc_versions_and_damage():
    for version in (1, 2):
        data = warc.arc_version_block("a.arc", version) + b"\n"
        for k, html in enumerate([b"", b"<p>\n\nx\r\n\r\ny</p>\n", b"z"]):
            data += warc.arc_record(f"http://a.b/{k} c", warc.page_block(html, k), version, "a.arc", len(data)) + b"\n"
        head, *records = warc.parse_arc(io.BytesIO(data))
        assert head.kind == "warcinfo"
        assert [warc.split_http(r.block)[1] for r in records] == [b"", b"<p>\n\nx\r\n\r\ny</p>\n", b"z"]
        assert all(r.version == version and r.archive == "a.arc" and " " not in r.url for r in records)
        for damaged in (data[:-5], data.replace(b" 20200101000000 text/html", b" then text/html")):
            with pytest.raises(ValueError):
                list(warc.parse_arc(io.BytesIO(damaged)))
    mixed = warc.arc_version_block("a.arc", 2) + b"\n" + warc.arc_record("u", b"x", 1, "a.arc", 0) + b"\n"
    with pytest.raises(ValueError):
        list(warc.parse_arc(io.BytesIO(mixed)))


def test_dates():
    assert [warc.warc_date(d) for d in ("2020", "202006", "20200600", "19970214101530")] == ["2020-01-01T00:00:00Z", "2020-06-01T00:00:00Z", "2020-06-01T00:00:00Z", "1997-02-14T10:15:30Z"]


IMAGE = bytes(range(256)) * 3
LATIN = "<p>caf\u00e9 \u00fc</p>".encode("latin-1")


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("most_keys", [100, 0])
def test_legacy_archives(spark, tmp_path, version, most_keys):
    """Hand-made archives with an image, a Latin-1 page, a dns record, a url with spaces and short dates, one of them gzip in several members."""
    tail = " 200 abc - 0 a.arc" if version == 2 else ""
    names = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length" if version == 2 else "URL IP-address Archive-date Content-type Archive-length"
    http = lambda kind, body: f"HTTP/1.0 200 OK\nContent-Type: {kind}\n\n".encode() + body  # noqa: E731  a server with bare line ends
    records = [
        ("http://h.example/a b.gif", "19970214", "image/gif", http("image/gif", IMAGE)),
        ("http://h.example/latin", "199702", "text/html; charset=iso-8859-1", http("text/html; charset=iso-8859-1", LATIN)),
        ("dns:h.example", "19970214101530", "text/dns", b"19970214101530\nh.example. 60 IN A 10.0.0.1\n"),
        ("http://h.example/again", "1998", "image/gif", http("image/gif", IMAGE)),
    ]
    for n, zipped in enumerate((False, True)):
        body = f"{version} 0 Crawler\n{names}\n\n".encode()
        parts = [f"filedesc://a{n}.arc 0.0.0.0 19970214 text/plain{tail} {len(body)}\n".encode() + body]
        parts += [f"{url} 10.0.0.1 {date} {kind}{tail} {len(block)}\n".encode() + block for url, date, kind, block in records]
        (tmp_path / f"a{n}.arc{'.gz' * zipped}").write_bytes(b"".join(gzip.compress(p + b"\n") if zipped else p + b"\n" for p in parts))
    out = staging_path(spark, "warc")
    warc.convert(spark, str(tmp_path), out, most_keys=most_keys)
    got = warc.resolved(warc.read_warcs(spark, out)).collect()
    sha = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    want = [(url.replace(" ", "%20"), sha(warc.split_http(block)[1]), len(warc.split_http(block)[1]), kind) for url, _, kind, block in records] * 2
    assert sorted((g.target_uri, g.payload_digest, g.payload_bytes, g.content_type) for g in got) == sorted(want)
    kinds = sorted((g.record_type, g.target_uri) for g in got)
    assert [k for k, u in kinds if u.startswith("dns:")] == ["resource"] * 2  # equal, but without an HTTP header to keep
    assert [k for k, u in kinds if "gif" in u or "again" in u].count("response") == 1 and [k for k, u in kinds if "latin" in u] == ["response", "revisit"]
    dates = {g.target_uri: g.warc_date for g in got}
    assert dates["http://h.example/latin"] == "1997-02-01T00:00:00Z" and dates["http://h.example/again"] == "1998-01-01T00:00:00Z"
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in sorted(Path(out).glob("*.gz")))
    info = [h for h, _ in warc.parse_warc(io.BytesIO(raw)) if h["warc-type"] == "warcinfo"]
    assert sorted(h["warc-filename"] for h in info) == ["a0.arc", "a1.arc"]


def test_archives_roll(spark, monkeypatch, tmp_path):
    pages = spark.createDataFrame([(k, f"http://h/{k}", "x" * 900) for k in range(40)], "page_id long, url string, html string").coalesce(1)
    monkeypatch.setattr(warc, "CHUNK", 2000)
    monkeypatch.setattr(warc, "ARCHIVE_CHUNKS", 3)
    monkeypatch.setitem(warc._ROLLED, "maxRecordsPerFile", 3)
    warc.write_arcs(pages, str(tmp_path / "arcs"))
    files = sorted((tmp_path / "arcs").glob("*.gz"))
    assert len(files) > 4
    for f in files:
        head, *records = warc.parse_arc(io.BytesIO(gzip.decompress(f.read_bytes())))
        assert head.kind == "warcinfo" and 0 < len(records) < 8


@pytest.mark.parametrize("min_bytes", [0, 3])
def test_warc_round_trip(spark, min_bytes):
    html = ["<p>a</p>", "<p>a</p>", "", None, "x", "x", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n\r\n", "\n\nhttp://u 0 0 t 5\n", "é🙂", "<p>a</p>"]
    rows = [(100 - k, None if k == 4 else f"http://h.example/{k} z", h, "extra") for k, h in enumerate(html)] + [(7, "http://d", "twice", "e"), (7, "http://d", "twice", "e"), (None, "http://n", "twice", "e")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    got = warc.convert_pages(spark, pages, min_bytes).collect()
    payload = {p: (h or "").encode() for p, _, h, _ in rows}
    assert sorted(str(g.page_id) for g in got) == sorted(str(r[0]) for r in rows)
    first = {}
    for p, b in payload.items():
        if p is not None:
            first[b] = min(p, first.get(b, p))
    for g in got:
        b = payload[g.page_id]
        assert g.payload_bytes == len(b) and g.payload_digest == base64.b32encode(hashlib.sha1(b).digest()).decode()
        if g.page_id in (7, None):
            continue
        response = len(b) < min_bytes or first[b] == g.page_id
        assert (g.record_type == "response") == response and g.refers_to == (None if response else first[b])
    twice = [g for g in got if g.page_id in (7, None)]
    assert sorted(g.record_type for g in twice) == ["response", "revisit", "revisit"] and {g.refers_to for g in twice if g.record_type == "revisit"} == {7}


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.convert_pages(spark, pages).count() == 0
    assert staging_path(spark, "x") != staging_path(spark, "x")


def test_slices_of_ids_that_lie_close(spark):
    """Ids dense in one place, alone in another, and repeated: every document meets its successor, and no slice is large but one of one id."""
    ids = [*range(10**15, 10**15 + 30_000), *range(0, 10**14, 10**12), *[7] * 50]
    docs = spark.createDataFrame([(k, f"t{k}") for k in ids], "doc_id long, text string")
    sizes = fingerprints.sliced(docs, slice_rows=100, max_cuts=8).groupBy("__slice").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids")).collect()
    assert max(r.n for r in sizes) <= 4 * 100
    order = [r.doc_id for r in fingerprints.sliced(docs, slice_rows=100, max_cuts=8).orderBy("__slice", "doc_id").collect()]
    assert order == sorted(ids)
    found = {r.doc_id: r.next_text for r in fingerprints.with_successor(docs.where("doc_id <> 7"), ["text"], 100, 8).collect()}
    left = sorted(set(ids) - {7})
    assert found == {a: f"t{b}" for a, b in zip(left, [*left[1:], left[0]], strict=True)}
