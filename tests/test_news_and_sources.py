from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import classify, text
from ledgerline.operators import cluster, scans
from ledgerline.plans import feeds
from ledgerline.sources import extract, readers


@pytest.mark.parametrize(("titles", "stories"), [
    (["OpenAI releases GPT-X", "OpenAI Releases GPT-X, Its Biggest Model Yet"], 1), (["Central bank holds rates", "The central bank holds rates, again"], 1),
    (["OpenAI releases GPT-X", "OpenAI hires a new chief financial officer"], 2), (["It begins", "It begins"], 2),
])
def test_clusters(spark, titles, stories):
    df = spark.createDataFrame([(i, f"s{i}", f"http://x/{i}", t, "c") for i, t in enumerate(titles)], "id long, source string, url string, title string, category string")
    df = df.withColumn("words", text.signature(text.normal_title(F.col("title"))))
    assert cluster.cluster(df, "category").select("story_id").distinct().count() == stories


def test_same_url_merges_only_across_sources():
    words = ["alpha", "beta"], ["gamma", "delta"]
    assert cluster.fold([("a", "u", words[0]), ("a", "u", words[1])], 0.7) == [0, 1]
    assert cluster.fold([("a", "u", words[0]), ("b", "u", words[1])], 0.7) == [0, 0]
    assert cluster.fold([("a", "u", words[0]), ("a", "u", words[1])], 0.7, same_source_urls=True) == [0, 0]


def plain_clusters(items, threshold, same):
    """The lowest cluster of any earlier match, item by item."""
    out = []
    for k, (source, url, words) in enumerate(items):
        found = [out[j] for j, (s, u, w) in enumerate(items[:k]) if (url and u == url and (same or s != source)) or (min(len(words), len(w)) > 1 and len(words & w) / min(len(words), len(w)) >= threshold)]
        out.append(min(found, default=k))
    return out


def test_components_fold_like_whole_groups(spark):
    import random

    r = random.Random(3)
    rows = []
    for i in range(400):
        words = r.sample([f"w{k}" for k in range(40)], r.randrange(0, 7)) if i % 3 else [["w1", "w2", "w3"], ["w3", "w2", "w9", "w1"], ["w9", "w8", "w3"]][r.randrange(3)]
        rows.append((i * 3 % 1201, r.choice("abc"), r.choice(["", "", f"u{r.randrange(60)}", None]), words if i % 50 else None, r.choice(["x", "y", None])))
    df = spark.createDataFrame(rows, "id long, source string, url string, words array<string>, category string")
    for threshold, same in ((0.7, False), (0.5, True)):
        want = {}
        for g in ("x", "y", None):
            mine = sorted(x for x in rows if x[4] == g)
            found = plain_clusters([(s, u, set(w or [])) for _, s, u, w, _ in mine], threshold, same)
            assert found == cluster.fold([(s, u, sorted(w or [])) for _, s, u, w, _ in mine], threshold, same)
            want |= {x[0]: mine[k][0] for x, k in zip(mine, found, strict=True)}
        got = {x.id: x.story_id for x in cluster.cluster(df, "category", threshold, same).collect()}
        assert got == want
        # The same in three scans, each behind the last.
        stored = None
        for low, high in ((0, 400), (400, 800), (800, 1201)):
            some = df.where(f"id >= {low} and id < {high}")
            found = cluster.cluster(some, "category", threshold, same) if stored is None else cluster.extend(stored, some, "category", threshold, same)
            placed = some.join(spark.createDataFrame(found.collect(), "id long, story_id long"), "id")
            stored = placed if stored is None else stored.unionByName(placed)
        assert {x.id: x.story_id for x in stored.select("id", "story_id").collect()} == want
    sets = {}
    for i, _, _, words, g in sorted(rows, key=lambda x: x[0]):
        sets.setdefault((frozenset(words or []), g), []).append(i)
    sets = [(w, g, ids) for (w, g), ids in sets.items() if g and len(w) > 1]
    brute = {(p[0], q[0], len(p), len(q)) for w, g, p in sets for v, h, q in sets if p[0] < q[0] and g == h and len(w & v) / min(len(w), len(v)) >= 0.6}
    assert {(x.a, x.b, x.n_a, x.n_b) for x in cluster.similar_pairs(df.where("category is not null"), "category", 0.6).collect()} == brute


def test_a_wire_story_told_many_times(spark):
    """100,000 equal titles are one node: no pairs, and one story, in seconds; a like title between them changes nothing."""
    import time

    n = 100_000
    df = spark.range(n).select("id", F.concat(F.lit("s"), (F.col("id") % 7).cast("string")).alias("source"), F.lit("").alias("url"), F.lit("c").alias("category"))
    equal = df.withColumn("words", F.array(*map(F.lit, ("alpha", "beta", "gamma"))))
    began = time.time()
    assert cluster.similar_pairs(equal, "category").count() == 0
    assert [tuple(r) for r in cluster.cluster(equal, "category").groupBy("story_id").count().collect()] == [(0, n)]
    mixed = equal.withColumn("words", F.when(F.col("id") == n // 2, F.array(*map(F.lit, ("alpha", "beta", "delta")))).otherwise(F.col("words")))
    assert [tuple(r) for r in cluster.cluster(mixed, "category", 0.6).groupBy("story_id").count().collect()] == [(0, n)]
    assert time.time() - began < 60


def test_a_chain_of_titles_takes_few_rounds(spark, monkeypatch):
    """Each title is like its neighbours alone: one story of them all, passed along in a logarithm of rounds, and never gathered in a task."""
    n, rounds = 1000, []
    stash = cluster.stash
    monkeypatch.setattr(cluster, "stash", lambda df, label, **options: (rounds.append(label), stash(df, label, **options))[1])
    words = F.concat(F.array(F.lit("all")), F.transform(F.array(*map(F.lit, range(3))), lambda k: F.concat(F.lit("w"), (F.col("id") + k).cast("string"))))
    df = spark.range(n).select("id", F.lit("s").alias("source"), F.lit("").alias("url"), F.lit("c").alias("category"), words.alias("words"))
    found = cluster.cluster(df, "category", 0.7)
    assert "InPandas" not in found._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in found.groupBy("story_id").count().collect()] == [(0, n)]
    assert 2 < rounds.count("stories") < 16


def test_a_chain_goes_on_behind_stored_titles(spark, monkeypatch):
    """The second half of a chain follows the stored first one in few rounds, and its words are numbered once."""
    n, labels = 300, []
    words = F.concat(F.array(F.lit("all")), F.transform(F.array(*map(F.lit, range(3))), lambda k: F.concat(F.lit("w"), (F.col("id") + k).cast("string"))))
    df = spark.range(n).select("id", F.lit("s").alias("source"), F.lit("").alias("url"), F.lit("c").alias("category"), words.alias("words"))
    stash = cluster.stash
    monkeypatch.setattr(cluster, "stash", lambda df, label, **options: (labels.append(label), stash(df, label, **options))[1])
    found = cluster.extend(df.where("id < 150").withColumn("story_id", F.lit(0).cast("long")), df.where("id >= 150"), "category", 0.7)
    assert [tuple(r) for r in found.groupBy("story_id").count().collect()] == [(0, 150)]
    assert 2 < labels.count("stories") < 14 and labels.count("word-numbers") == 1


def test_words_with_and_without_bits(spark):
    """A group of more words than there are bits: pairs by frequent words, by rare ones and by both, against all pairs."""
    import random

    r = random.Random(5)
    weights = [1 / (k + 1) for k in range(1500)]
    rows = [(i, "c", sorted({f"w{k}" for k in r.choices(range(1500), weights, k=r.randrange(2, 30))})) for i in range(500)]
    rows += [(500 + i, "c", sorted({*rows[i][2][: len(rows[i][2]) // 2 + 1], f"w{i}"})) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, category string, words array<string>")
    assert len({w for _, _, words in rows for w in words}) > 64 * cluster.BITS
    sets = {}
    for i, _, words in rows:
        sets.setdefault(frozenset(words), i)
    sets = [(w, i) for w, i in sets.items() if len(w) > 1]
    for threshold in (0.5, 0.7):
        brute = {(i, j): len(w & v) / min(len(w), len(v)) for w, i in sets for v, j in sets if i < j and len(w & v) / min(len(w), len(v)) >= threshold}
        found = cluster.similar_pairs(df, "category", threshold).collect()
        assert len(found) == len(brute) and {(x.a, x.b): x.overlap for x in found} == brute


def test_copies_are_found_in_stored_words(spark, monkeypatch):
    """Titles are taken apart once, for the sets and for their copies."""
    counted, labels, stash = spark.sparkContext.accumulator(0), [], cluster.stash

    @F.udf("array<string>")
    def words(k):
        counted.add(1)
        return ["a", "b", f"w{k % 3}"]

    monkeypatch.setattr(cluster, "stash", lambda df, label, **options: (labels.append(label), stash(df, label, **options))[1])
    df = spark.range(12).select("id", F.lit("c").alias("category"), words.asNondeterministic()("id").alias("words"))
    assert cluster.pairs_and_members(df, "category", 0.5).count() == 3 + 9
    assert counted.value == 12 and labels[0] == "told-items"


def test_a_story_row_gathers_no_titles(spark):
    """Of a story's titles only the first is kept; domains stay in order of appearance, a null one and repeated ones too."""
    import re

    rows = [(5, "b", "y.org", "late"), (1, "a", "x.org", "first"), (2, "b", None, "next"), (3, "c", "x.org", "more"), (9, "a", "z.org", "alone")]
    df = spark.createDataFrame(rows, "id long, source string, domain string, title string")
    clustered = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (5, 1), (9, 9)], "id long, story_id long")
    found = cluster.stories(df, clustered)
    assert not re.search(r"collect_list\([^)]*title", found._jdf.queryExecution().toString())
    assert sorted(tuple(x) for x in found.collect()) == [(1, 4, 3, [1, 2, 3, 5], ["x.org", None, "y.org"], "first"), (9, 1, 1, [9], ["z.org"], "alone")]


def test_many_sources_at_an_address(spark):
    """Of an address's sources each hears all others and not itself, a null source too."""
    sources = [None, "a", "b", "c", "d", None, "a"]
    rows = [(k, s, "u", ["x"], "c") for k, s in enumerate(sources)] + [(10, "a", "v", ["y"], "c"), (11, "a", "v", ["z"], "c")]
    df = spark.createDataFrame(rows, "id long, source string, url string, words array<string>, category string")
    assert {x.id: x.story_id for x in cluster.cluster(df, "category").collect()} == {k: 0 for k in range(7)} | {10: 10, 11: 11}
    assert {x.id: x.story_id for x in cluster.cluster(df.where("id in (0, 5)"), "category").collect()} == {0: 0, 5: 5}


def test_an_item_joins_the_first_cluster_with_a_match():
    a, b = ["a1", "a2", "a3"], ["b1", "b2", "b3"]
    assert cluster.fold([("s", "", a), ("t", "", b), ("u", "", ["a1", "a2", "b1", "b2"]), ("v", "", b)], 0.6) == [0, 1, 0, 0]


def test_normal_forms_differ(spark):
    df = spark.createDataFrame([("  Ｃafé  NEWS ",), (None,)], "t string")
    got = df.select(text.normal_title(F.col("t")).alias("a"), text.plain_title(F.col("t")).alias("b")).collect()
    assert got[0].a == "café news" and got[0].b == "cafe news" and got[1].a is None


def test_urls(spark):
    u = "https://www.Example.com/Path/?utm_source=x&ID=1&FBCLID=2#frag"
    df = spark.createDataFrame([(u,), ("not a url",), (None,)], "u string")
    got = df.select(text.canonical_feed_url(F.col("u")).alias("f"), text.canonical_news_url(F.col("u")).alias("n"), text.domain_of(F.col("u"), "unknown").alias("d")).collect()
    assert got[0].f == "https://www.example.com/Path/?ID=1&FBCLID=2" and got[0].n == "https://www.example.com/Path?ID=1" and got[0].d == "example.com"
    assert got[1].f == "not a url" and got[1].d == got[2].d == "unknown"


@pytest.mark.parametrize(("title", "want"), [
    ("Nvidia raises its full-year guidance", "guidance"), ("Apple beats estimates on iPhone sales", "earnings"), ("AMD to acquire ZT Systems", "ma"), ("SEC opens probe into Tesla", "legal_regulatory"),
    ("Boeing wins $2 billion contract", "contract"), ("Meta announces $50 billion buyback", "capital"), ("Intel names new CEO", "leadership"), ("Company unveils next-gen GPU platform", "product"),
    ("Analysts lift price target", "analyst"), ("Shares of X fall 5%", "price_move"), ("3 Cheap Stocks To Buy Now", "noise"), ("Is Nvidia a buy?", "noise"), ("", "noise"), (None, "noise"), ("Something else entirely", "unclassified"),
])
def test_classes(spark, title, want):
    assert spark.createDataFrame([(title,)], "t string").select(classify.classify(F.col("t"))).first()[0] == want


def test_scores(spark):
    df = spark.createDataFrame([("earnings", ["Reuters", "CNBC", "Zacks"], True, None), ("earnings", ["Zacks", "MSN"], False, "AMD"), ("price_move", ["Reuters", "a", "b", "c", "d", "e"], True, None), ("noise", ["Reuters"], True, None)], "c string, s array<string>, h boolean, p string")
    got = [r.v for r in df.select(classify.assess(F.col("c"), F.col("s"), F.col("h"), F.col("p")).alias("v")).collect()]
    assert [g.score for g in got] == [87, 26, 52, 0] and [g.band for g in got] == ["high", "low", "medium", "low"]
    assert "aggregators only (-18)" in got[1].reasons


def test_subjects(spark):
    df = spark.createDataFrame([("NVDA", "NVIDIA Corporation", "Nvidia ships"), ("T", "AT&T Inc.", "The T is late"), ("T", "AT&T Inc.", "Analysts on $T today"), ("0700.HK", "Tencent Holdings", "At 0700 hours"), ("0700.HK", "Tencent Holdings", "Tencent Holdings up")], "k string, n string, t string")
    got = [r.m for r in df.select(classify.mentions(F.col("t"), F.col("k"), classify.aliases(F.col("k"), F.col("n"))).alias("m")).collect()]
    assert got == [True, False, True, False, True]


RSS = """<rss xmlns:dc="x"><channel><item><title>A &amp; B ,ok</title><link>/a?utm_source=1</link><description><![CDATA[<p>Hi <b>there</b></p>]]></description><pubDate>Mon</pubDate></item>
<item><title></title></item><item><dc:title>Second</dc:title></item></channel></rss>"""
HTML = """<html><nav><a href="/x">nav</a></nav><ul class="list"><li class="i"><a class="t" href="one.html">One&nbsp;story</a><span class="d">today</span></li><li class="i"><b>No link</b></li></ul><script>var a='<li>'</script></html>"""


def test_items_after_the_tenth_stay(spark, tmp_path):
    body = "<nav>" + "".join(f'<li><a href="/{k}">Title {k}</a></li>' for k in range(45)) + "</nav>"
    spark.createDataFrame([(1, "https://h.example/", body)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    for query in (feeds.listing_items, feeds.pattern_items):
        assert sorted(r.position for r in query(spark, str(tmp_path)).collect()) == list(range(40))


def test_extraction(spark):
    pages = spark.createDataFrame([("s", "https://h.example/dir/page", RSS)], "source string, url string, body string")
    got = extract.feed_items(pages).orderBy("position").collect()
    assert [(g.title, g.url, g.summary, g.date_text) for g in got] == [("A & B, ok".replace(", ok", ",ok"), "https://h.example/a", "Hi there", "Mon"), ("Second", "https://h.example/dir/page", None, None)]
    pages = spark.createDataFrame([("s", "https://h.example/dir/page", HTML)], "source string, url string, body string")
    got = extract.listing_items(pages, {"list": "ul.list > li.i", "title": "", "date": "span.d"}).orderBy("position").collect()
    assert [(g.title, g.url) for g in got] == [("One story today", "https://h.example/dir/one.html"), ("No link", "https://h.example/dir/page")]
    got = extract.listing_items(pages, {"list": "li", "title": "a.t", "link": "a.t@href"}).collect()
    assert [(g.title, g.url) for g in got] == [("One story", "https://h.example/dir/one.html")]
    got = extract.pattern_items(pages, r'<a class="t" href="([^"]+)">(.*?)</a>', {"link": 1, "title": 2}).first()
    assert got.url == "https://h.example/dir/one.html"
    assert extract.feed_items(pages).count() == 0


def test_readable_and_decoded(spark):
    df = spark.createDataFrame([(HTML, bytearray("é".encode()), "utf-8"), (None, bytearray("é".encode("latin-1")), None)], "h string, b binary, c string")
    got = df.select(extract.readable_text(F.col("h")).alias("t"), extract.decoded(F.col("b"), F.col("c")).alias("d")).collect()
    assert "nav" not in got[0].t and "One&nbsp;story today No link" in got[0].t and [g.d for g in got] == ["é", "\ufffd"]
    tried = [("香港".encode("big5"), None), ("价格".encode("gb18030"), "gb2312"), ("é".encode("latin-1"), "iso-8859-1"), (b"plain", "no-such-charset"), (None, None), ("日本".encode("shift_jis"), "utf-8")]
    df = spark.createDataFrame([(k, None if b is None else bytearray(b), c) for k, (b, c) in enumerate(tried)], "k int, b binary, c string")
    texts = [r.d for r in df.select("k", extract.decoded(F.col("b"), F.col("c")).alias("d")).orderBy("k").collect()]
    assert texts[:5] == ["香港", "价格", "é", "plain", None]


FEEDS = [
    """<?xml version="1.0"?><!-- <item>no</item> --><rss xmlns:content="http://x" xmlns:dc="http://d"><channel><title>t</title><item><title><![CDATA[A </item> & b]]></title><link>/1</link><description>x &lt;b&gt;bold&lt;/b&gt;</description><pubDate>Mon</pubDate></item><item><title>B xmlns="q" dc:x</title><dc:date>2020</dc:date><content:encoded><![CDATA[<p>hi</p>]]></content:encoded></item><item><link>/untitled</link></item></channel></rss>""",
    """<feed xmlns="http://www.w3.org/2005/Atom"><title>f</title><entry><title type="html">T1</title><link href="http://b.example/1"/><published>P</published><content type="xhtml"><div>yo <b>there</b></div></content></entry></feed>""",
    """<rdf:RDF xmlns:rdf="r" xmlns="x"><channel><title>q</title></channel><item><title>R1</title><link>http://c.example/1</link></item></rdf:RDF>""",
    "<rss><item>", "not xml", None,
]


def test_feeds_are_parsed_as_xml(spark):
    pages = spark.createDataFrame([(str(k), "https://h.example/p", b) for k, b in enumerate(FEEDS)], "source string, url string, body string")
    got = {(r.source, r.title): (r.url, r.summary, r.date_text) for r in extract.feed_items(pages).collect()}
    assert got == {
        ("0", "A </item> & b".replace("</item> ", " ").replace("  ", " ")): ("https://h.example/1", "x bold", "Mon"), ("0", 'B xmlns="q" dc:x'): ("https://h.example/p", "hi", "2020"),
        ("1", "T1"): ("http://b.example/1", "yo there", "P"), ("2", "R1"): ("http://c.example/1", None, None),
    }
    assert sorted(r.source for r in extract.broken_feeds(pages).collect()) == ["3", "4", "5"]


def test_landed_responses(spark, tmp_path):
    import base64
    import json

    row = lambda url, attempt, status, body=b"", **more: json.dumps({"url": url, "attempt": attempt, "status": status, "body": base64.b64encode(body).decode(), **more})
    lines = [row("a", 0, 503), row("a", 1, 200, "新聞".encode("big5"), etag="n"), row("b", 0, 304), row("c", 0, 404), row("c", 1, 200, b"never asked"), row("d", 0, 500), row("d", 1, None), row("d", 2, 502), "broken {"]
    (tmp_path / "landed.jsonl").write_text("\n".join(lines))
    known = spark.createDataFrame([("b", "old", "Mon"), ("a", "old", None)], "url string, etag string, last_modified string")
    got = {r.url: r for r in readers.conditional_responses(readers.landed(spark, str(tmp_path)), known).collect()}
    assert (got["a"].outcome, got["a"].text, got["a"].etag) == ("fresh", "新聞", "n")
    assert (got["b"].outcome, got["b"].text, got["b"].etag, got["b"].last_modified) == ("unchanged", None, "old", "Mon")
    assert got["c"].problem == "HTTP 404 after 1 attempts" and got["d"].problem == "HTTP 502 after 3 attempts"


def test_files_by_age_and_magic(spark, tmp_path):
    import os
    from datetime import datetime

    for name, body in (("a.png", b"x"), ("b.png", b"x"), ("c.pdf", b"%PDF-1.7"), ("d.pdf", b"<html>")):
        (tmp_path / name).write_bytes(body)
    os.utime(tmp_path / "a.png", (1_700_000_000, 1_700_000_000))
    old = readers.stale_files(spark, str(tmp_path), F.lit(datetime(2023, 12, 1)).cast("timestamp"), 14)
    assert [r.path.rsplit("/", 1)[1] for r in old.collect()] == ["a.png"]
    kinds = {r.path.rsplit("/", 1)[1]: r.is_pdf for r in readers.documents_checked(spark, str(tmp_path)).collect()}
    assert kinds["c.pdf"] and not kinds["d.pdf"]


def test_normal_forms(spark):
    import unicodedata

    texts = ["Straße  ﬁne", "ÉCOLE\u3000Ⅷ", "İstanbul", "n\u0303o \u0345x", " a\u00a0b ", "हिन्दी", "", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = df.select("k", text.normal_title(F.col("t")).alias("n"), text.plain_title(F.col("t")).alias("p")).orderBy("k").collect()
    for g, t in zip(got, texts, strict=True):
        if t is None:
            assert g.n is None and g.p is None
            continue
        bare = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
        assert (g.n, g.p) == (" ".join(unicodedata.normalize("NFKC", t).casefold().split()), " ".join(bare.casefold().split()))


def test_publication(spark):
    page = "<a href='stat202512.pdf'>old</a> Supply <a href='stat202606.pdf'>x</a> 2026年6月 <a href='stat202603.pdf'>"
    df = spark.createDataFrame([("u", page), ("v", page.replace("6月", "5月")), ("w", "nothing"), ("z", "stat202605.pdf")], "url string, html string")
    got = {r.url: r for r in extract.newest_publication(df, "Supply").collect()}
    assert got["u"].href == "stat202606.pdf" and got["u"].problem is None and got["u"].q_index == 2026 * 4 + 2
    assert got["v"].problem == "label disagrees" and got["w"].problem == "no link" and got["z"].problem == "not a quarter end"


def test_figures(spark):
    rows = [(1, 0, "二", 0.0, 5.0), (1, 0, "已落成", 6.0, 20.0), (1, 0, "16,000", 30.0, 40.0), (1, 0, "9", 50.0, 55.0), (1, 1, "7", 0.0, 3.0)]
    df = spark.createDataFrame(rows, "page int, row int, text string, x0 double, x1 double")
    assert extract.figure_for_label(df, ["page"], "已落成").first().figure == 16000


def test_readers(spark, tmp_path):
    (tmp_path / "q.csv").write_text("﻿a,b,c,d,e\n2026/Jun,\"16,000\",61000,19000,96000\n2026/Mar,1,2,3,4\n\nbad,1,2,3,4\n2025/Dec,x,2,3,4\n")
    good, bad = readers.quarters(spark, str(tmp_path / "q.csv"))
    assert [r.quarter for r in good.collect()] == ["2026/Jun", "2026/Mar"] and good.first().land_ready == 16000 and bad.count() == 2
    (tmp_path / "c.json").write_text('{\n  // a comment\n  "url": "https://x//y"\n}')
    assert readers.commented_json(spark, str(tmp_path / "c.json"), "url string").first().url == "https://x//y"
    (tmp_path / "r.jsonl").write_text('{"at":"2026-01-01T00:00:00Z","status":"ok"}\nbroken\n{"at":"2026-01-02T00:00:00Z","status":"error"}\n')
    assert [r.status for r in readers.run_log(spark, str(tmp_path / "r.jsonl")).collect()] == ["error", "ok"]


def test_vendor_payloads(spark):
    flat = '{"title":"T","canonicalUrl":{"url":"u"},"pubDate":"2026-08-21T14:47:00Z","provider":{"displayName":"P"}}'
    raw = spark.createDataFrame([("X", None, '{"content":' + flat + "}"), ("X", None, flat), ("X", None, flat.replace('"title"', '"contentType":"VIDEO","title"')), ("X", None, '{"title":"no url"}')], "ticker string, peer_of string, payload string")
    assert readers.nested_news(raw).count() == 2
    scored = '{"title":"T","url":"u","time_published":"20260821T144700","ticker_sentiment":[{"ticker":"B","relevance_score":"0.9","ticker_sentiment_score":"0.1"},{"ticker":"A","relevance_score":"0.4","ticker_sentiment_score":"-0.2"}]}'
    got = readers.scored_news(spark.createDataFrame([("A", None, scored), ("B", None, scored)], "ticker string, peer_of string, payload string")).collect()
    assert [g.is_subject for g in got] == [False, True] and got[0].sentiment_score == -0.2 and got[0].published_at == datetime(2026, 8, 21, 14, 47)
    notes = spark.createDataFrame([('{"Information":"limit"}',), ("prose",), ('{"feed":[]}',)], "payload string")
    assert readers.refused(notes).count() == 2
    series = spark.createDataFrame([("s", '{"data":[{"date":"2026-01-02","value":"."},{"date":"2026-01-01","value":"4.5"}]}')], "series string, payload string")
    assert readers.newest_observation(series).first().value == 4.5


def test_bars_fail_over(spark):
    b = "ticker string, day date, open double, high double, low double, close double, volume double"
    day = lambda d: f"2026-01-0{d}"
    make = lambda rows: spark.createDataFrame(rows, b.replace("day date", "day string")).withColumn("day", F.to_date("day"))
    first = make([("A", day(1), 1.0, 2.0, 1.0, 1.5, None), ("A", day(2), None, 2.0, 1.0, 1.5, 1.0)])
    second = make([("A", day(1), 9.0, 9.0, 9.0, 9.0, 9.0), ("A", day(2), 3.0, 3.0, 3.0, 3.0, 3.0)])
    got = {str(r.day): (r.open, r.volume, r.degraded) for r in readers.bars(first, second).collect()}
    assert got == {day(1): (1.0, 0.0, False), day(2): (3.0, 3.0, True)}


def test_scans(spark):
    state = spark.createDataFrame([("a", datetime(2026, 1, 1, 12), 5, 0), ("b", datetime(2026, 1, 1, 9), 3, 2)], "source string, last_scan_at timestamp_ntz, recent_yield int, failures int")
    results = spark.createDataFrame([("a", True, 0, datetime(2026, 1, 1, 13)), ("b", False, 0, datetime(2026, 1, 1, 13)), ("c", True, 4, datetime(2026, 1, 1, 13))], "source string, ok boolean, yielded int, at timestamp_ntz")
    got = {r.source: r for r in scans.after_scan(state, results).collect()}
    assert got["a"].went_silent and got["a"].recent_yield == 5 and got["b"].failures == 3 and got["c"].recent_yield == 4
    sources = spark.createDataFrame([("a", 60), ("b", 60), ("d", 60)], "source string, min_interval_minutes int")
    now = F.lit("2026-01-01 12:30:00").cast("timestamp_ntz")
    assert [r.source for r in scans.throttled(state, sources, now).collect()] == ["a"]
    assert spark.createDataFrame([("0700.HK",), ("AAPL",), ("7203.T",)], "t string").select(scans.market_of(F.col("t"))["market"].alias("m")).collect()[0].m == "HK"


def test_summary_figures(spark):
    def row(doc, y, *words):
        return [(doc, t, float(x), x + 9.0, y + d, y + d + 4.0) for (x, t), d in zip(words, (0.0, 3.0, 1.0, 2.0), strict=False)]

    land, built, ready = extract.FIGURES.values()
    rows = row("a", 10, (0, "(二)"), (10, land[:5]), (20, land[5:]), (60, "16,000")) + row("a", 40, (5, "1"), (10, built), (50, "78,000"), (70, "9")) + row("a", 70, (10, ready), (50, "11,000"))
    rows += row("b", 10, (10, land), (5, "3")) + row("b", 40, (10, built), (50, "7,000"))
    df = spark.createDataFrame(rows, "doc string, text string, x0 double, x1 double, top double, bottom double")
    got = {r.doc: r for r in extract.summary_figures(df, ["doc"]).collect()}
    assert (got["a"].land_ready, got["a"].being_built, got["a"].built_not_sold, got["a"].problem) == (16000, 78000, 11000, None)
    assert got["b"].being_built == 7000 and got["b"].problem == "no figure for land_ready; no label for built_not_sold"
    text = spark.createDataFrame([("未來三至四年間，\n約有 105,000 伙",), ("none",)], "t string").select(extract.printed_total(F.col("t")).alias("n"))
    assert [r.n for r in text.collect()] == [105000, None]


def test_pdf_words_say_what_they_need(spark):
    import importlib.util

    if importlib.util.find_spec("pdfplumber") is None:
        with pytest.raises(ModuleNotFoundError, match="pdfplumber"):
            extract.pdf_words(spark.createDataFrame([], "path string, content binary"))


def test_long_titles_are_never_broadcast(spark):
    """A set of many words is small where it is stored and large where each word brings it along: no machine holds them all."""
    words = F.transform(F.sequence(F.lit(1), F.lit(60)), lambda k: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", k), F.lit(5000)).cast("string")))
    df = spark.range(200).select("id", F.lit("c").alias("category"), words.alias("words"))
    found = cluster.similar_pairs(df.unionByName(df.withColumn("id", F.col("id") + 1000).withColumn("words", F.slice("words", 1, 50))), "category", 0.9)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(x.a, x.b) for x in found.collect()} == {(k, k + 1000) for k in range(200)}


def test_copies_are_members(spark):
    """Pairs of first items, and each copy beside the first of its set: no item is lost."""
    rows = [(1, ["a", "b", "c"]), (2, ["c", "b", "a"]), (3, ["a", "b", "x"]), (4, ["a", "b", "c"]), (5, ["x", "b", "a"]), (6, ["z"])]
    df = spark.createDataFrame([(i, w, "c") for i, w in rows], "id long, words array<string>, category string")
    got = sorted(tuple(r) for r in cluster.pairs_and_members(df, "category", 0.5).collect())
    assert got == [(1, 2, 3, 3, 1.0), (1, 3, 3, 2, 2 / 3), (1, 4, 3, 3, 1.0), (3, 5, 2, 2, 1.0)]
