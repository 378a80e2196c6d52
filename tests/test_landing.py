"""The landing folder of HTTP responses as a data source: wire forms, offsets, the sink's commit."""

import gzip
import json
import zlib
from datetime import datetime

import pytest

from ledgerline.sources import landing
from ledgerline.streaming import ingest


def _ok(body: bytes, *header: str) -> bytes:
    return ("\r\n".join(["HTTP/1.1 200 OK", *header]) + "\r\n\r\n").encode() + body


def test_wire_forms():
    assert landing.parsed(_ok(b"abc", "Content-Length: 3", "ETag: \"x\"", "Content-Type: text/html; charset=Big5")) == (200, "big5", '"x"', None, b"abc")
    assert landing.parsed(_ok(b"3\r\nabc\r\n2\r\nde\r\n0\r\n\r\n", "Transfer-Encoding: chunked"))[4] == b"abcde"
    assert landing.parsed(_ok(gzip.compress(b"packed"), "Content-Encoding: gzip"))[4] == b"packed"
    assert landing.parsed(_ok(zlib.compress(b"packed"), "Content-Encoding: deflate"))[4] == b"packed"
    assert landing.parsed(b"HTTP/2 304 \r\nlast-modified: then\r\n\r\n") == (304, None, None, "then", b"")


@pytest.mark.parametrize("raw", [b"", b"nonsense", b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\nabc", _ok(gzip.compress(b"packed")[:-9], "Content-Encoding: gzip"), _ok(b"zz\r\n", "Transfer-Encoding: chunked")])
def test_what_cannot_be_read_has_no_status(raw):
    assert landing.parsed(raw) == (None,) * 5


def _land(root, fetcher, name, *responses):
    (root / fetcher).mkdir(parents=True, exist_ok=True)
    lines = b"".join(json.dumps({"url": u, "attempt": a, "fetched_at": at, "length": len(raw)}).encode() + b"\n" + raw for u, a, at, raw in responses)
    (root / fetcher / f"{name}{landing.ENDING}").write_bytes(lines)


def test_offsets_by_fetcher(tmp_path):
    """A slow fetcher's file with a lower name is met after a fast one's; nothing is met twice."""
    at = "2024-01-01T00:00:00+00:00"
    reader = landing.Offsets({"path": str(tmp_path)})
    assert reader.latestOffset() == {}
    _land(tmp_path, "fast", "0009", ("u", 0, at, b""))
    first = reader.latestOffset()
    _land(tmp_path, "slow", "0001", ("v", 0, at, b""))
    _land(tmp_path, "fast", "0010", ("w", 0, at, b""))
    _land(tmp_path, "_pending", "0011", ("x", 0, at, b""))
    second = reader.latestOffset()
    names = lambda a, b: [p.rsplit("/", 2)[1:] for lot in reader.partitions(a, b) for p in lot.paths]
    assert names({}, first) == [["fast", "0009.responses"]]
    assert names(first, second) == [["fast", "0010.responses"], ["slow", "0001.responses"]]
    assert names(second, second) == []
    assert len(landing.Offsets({"path": str(tmp_path), "lotbytes": "1"}).partitions({}, second)) == 3


def test_sink_and_source(spark, tmp_path):
    landing.register(spark)
    where = str(tmp_path / "in")
    assert spark.read.format("landed_responses").load(where).count() == 0
    rows = [(f"u{n}", 0, datetime(2024, 1, 1), None if n == 3 else _ok(b"x" * n, f"Content-Length: {n}")) for n in range(40)]
    df = spark.createDataFrame(rows, "url string, attempt int, fetched_at timestamp, response binary").repartition(4)
    for _ in range(2):
        df.write.format("landed_responses").option("fetcher", "a").option("lotbytes", 200).mode("append").save(where)
    got = spark.read.format("landed_responses").load(where).collect()
    assert sorted((r.url, r.status, len(r.body or b"")) for r in got) == sorted((u, None if raw is None else 200, 0 if raw is None else int(u[1:])) for u, _, _, raw in rows * 2)
    assert {r.fetched_at for r in got} == {datetime(2024, 1, 1)}
    folder = sorted(p.name for p in (tmp_path / "in" / "a").iterdir())
    assert {n[:12] for n in folder} == {"000000000000", "000000000001"} and len(folder) > 8
    assert list((tmp_path / "in" / "_pending").iterdir()) == []


def test_a_broken_tail_is_left_out(spark, tmp_path):
    landing.register(spark)
    _land(tmp_path, "a", "1", ("u", 0, None, _ok(b"abc", "Content-Length: 3")), ("v", 0, None, _ok(b"abc", "Content-Length: 3")))
    whole = (tmp_path / "a" / "1.responses").read_bytes()
    (tmp_path / "a" / "1.responses").write_bytes(whole[:-2])
    assert [(r.url, bytes(r.body), r.fetched_at) for r in spark.read.format("landed_responses").load(str(tmp_path)).collect()] == [("u", b"abc", None)]


def test_validators_survive_batches_and_restarts(spark, tmp_path):
    """Three runs of one stream: a fetch whose attempts land apart, an unchanged page, one that fails for good."""
    landing.register(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = []

    def run():
        stream = ingest.answers(spark.readStream.format("landed_responses").load(str(tmp_path / "in")))
        q = stream.writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(lambda df, _: got.append(sorted((r.url, r.outcome, r.text, r.etag) for r in df.collect()))).start()
        q.awaitTermination()

    day = "2024-01-0{}T00:00:00+00:00".format
    bad = b"HTTP/1.1 503 x\r\nContent-Length: 0\r\n\r\n"
    fresh = _ok("é".encode("latin-1"), "Content-Length: 1", "ETag: 1", "Content-Type: text/plain; charset=latin-1")
    _land(tmp_path / "in", "a", "1", ("u", 0, day(1), fresh), ("v", 0, day(1), bad))
    run()
    _land(tmp_path / "in", "b", "1", ("v", 1, day(1), fresh))
    _land(tmp_path / "in", "a", "2", ("u", 0, day(2), b"HTTP/1.1 304 x\r\n\r\n"))
    run()
    _land(tmp_path / "in", "a", "3", *[("u", n, day(3), bad) for n in range(3)], ("v", 0, day(3), b"HTTP/1.1 410 x\r\nContent-Length: 0\r\n\r\n"))
    run()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    told = [b for b in got if b]
    assert told == [[("u", "fresh", "é", "1")], [("u", "unchanged", None, "1"), ("v", "fresh", "é", "1")], [("u", "failed", None, "1"), ("v", "failed", None, "1")]]


def test_rounds_keep_to_their_day(spark, tmp_path):
    """However large a page's number: what tells the rounds apart is the day."""
    from ledgerline.plans import streams

    spark.createDataFrame([(k, f"u{k}", "x") for k in (1, 86_399, 86_400, 7_000_003)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    for n in (1, 2):
        days = {r.d for r in streams._fetched(spark, str(tmp_path), n).selectExpr("day(fetched_at) as d").collect()}
        assert days == {n}
