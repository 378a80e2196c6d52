from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from ledgerline import schemas
from ledgerline.operators import registers, state
from ledgerline.plans import reports
from ledgerline.sources import config

NEWS = "id long, ticker string, peer_of string, url string, title string, source string, notified_at timestamp_ntz, first_seen_at timestamp_ntz, suppressed boolean, sentiment_score double, sentiment_label string"
T0 = datetime(2026, 8, 1)


def news(spark, *rows):
    return spark.createDataFrame([(i, "X", p, f"http://u/{i}", t, s, n, T0, sup, sc, "l" if sc is not None else None) for i, (t, s, p, n, sup, sc) in enumerate(rows)], NEWS)


def test_stories(spark):
    df = news(spark, ("Acme beats quarterly estimates", "Reuters", None, None, False, 0.5), ("Acme beats quarterly estimates again", "Zacks", None, None, False, None), ("Rival to acquire Beta", "MSN", "BETA", None, False, 0.1), ("Old Acme lawsuit", "CNBC", None, T0, False, None), ("Acme stock rises", "CNBC", None, None, True, None))
    got = {r.story_id: r for r in reports.stories(reports.pending_news(df), spark.createDataFrame([("X",)], "ticker string")).collect()}
    assert set(got) == {0, 2} and got[0].ids == [0, 1] and got[0].score == 50 + 12 + 6 + 15 and got[0].sentiment == 0.5 and got[0].scored_copies == 1
    assert got[2].about_competitor == '["BETA"]' and got[2].score == 48 - 18 + 15 - 12
    none = spark.createDataFrame([], "ticker string")
    assert reports.pending_news(df, none).count() == 0


def test_report_caps_before_it_stamps(spark):
    df = news(spark, *[(f"Acme{i} wins contract{i} number{i}", "CNBC", None, None, False, None) for i in range(15)])
    events = spark.createDataFrame([("X", "earnings", date(2026, 8, 10), None), ("X", "earnings", date(2027, 8, 10), None)], "ticker string, kind string, event_date date, notified_at timestamp_ntz")
    bars = spark.createDataFrame([("X", date(2026, 7, d), 1.0, 2.0, 1.0, 1.5, 9.0) for d in range(1, 20)], "ticker string, day date, open double, high double, low double, close double, volume double")
    members = spark.createDataFrame([("s", "X"), ("s", "Y")], "sector string, ticker string")
    readings = spark.createDataFrame([], "series string, as_of date, value double, notified_at timestamp_ntz")
    r = reports.desk_report(bars, None, df, events, members, readings, spark.createDataFrame([], "series string, move double"), F.lit(date(2026, 8, 1)))
    assert r.capped.count() == 12 and r.capped.first().held == 3 and r.events.count() == 1
    assert r.stamps(F.lit(T0)).count() == 13 and not r.quiet()
    assert r.status_lines.first().line == "X — not enough history yet" and r.sectors.first().cohesion == "unknown"
    assert reports.pending_summary(df, events, F.lit(date(2026, 8, 1))).first().pending == 16


def test_digest(spark):
    items = spark.createDataFrame([(1, "a", "http://a/1", "Alpha beta gamma", "a.x"), (2, "b", "http://b/1", "Alpha beta gamma delta", "b.x"), (3, "gone", "http://c/1", "Other words entirely", "c.x"), (4, "a", "http://a/2", "Seen before now", "a.x")], "id long, source string, url string, title string, domain string")
    items = items.withColumn("words", F.split(F.lower("title"), " "))
    sources = spark.createDataFrame([("a", "tech"), ("b", "tech")], "source string, category string")
    ledger = state.Ledger(spark.createDataFrame([("news", "4", T0)], state.Ledger.SCHEMA), "news")
    got = reports.digest(items, sources, ledger, ["tech"]).collect()
    assert [(r.category, r.ids, r.domains) for r in got] == [("tech", [1, 2], ["a.x", "b.x"]), ("uncategorised", [3], ["c.x"])]


def test_upserts_by_key(spark):
    cols = "series string, as_of date, value double, fetched_at timestamp_ntz, notified_at timestamp_ntz"
    old = spark.createDataFrame([("s", date(2026, 1, 1), 4.5, T0, None)], cols)
    new = spark.createDataFrame([("s", date(2026, 1, 1), 9.9, datetime(2026, 9, 1), T0)], cols)
    row = registers.upsert("macro", old, new).first()
    assert row.value == 4.5 and row.fetched_at == datetime(2026, 9, 1) and row.notified_at is None
    assert set(schemas.KEYS) == set(schemas.TABLES)


def test_quarters_are_not_overwritten(spark):
    cols = "quarter string, q_index int, land_ready int, being_built int, built_not_sold int, total int"
    old = spark.createDataFrame([("2026/Mar", 8105, 1, 2, 3, 6)], cols)
    new = spark.createDataFrame([("2026/Mar", 8105, 9, 9, 9, None), ("2026/Jun", 8106, 1000, 2000, 3000, None), ("2026/Sep", 8107, 1000, 2000, 3000, 20000)], cols)
    good, refused = registers.add_quarter(old, new)
    assert {r.quarter: r.total for r in good.collect()} == {"2026/Jun": 6000, "2026/Sep": 20000} and refused.count() == 1
    assert [r.quarter for r in registers.total_mismatch(good).collect()] == ["2026/Sep"]


def test_media_is_reused_within_an_account(spark):
    old = spark.createDataFrame([("m1", "A", "h")], "media_id string, account_id string, sha256 string")
    files = spark.createDataFrame([("A", "h", "p"), ("B", "h", "q")], "account_id string, sha256 string, path string")
    got = {r.account_id: r for r in registers.register_media(old, files).collect()}
    assert got["A"].media_id == "m1" and got["A"].reused and not got["B"].reused


def test_purge_selection(spark):
    df = spark.createDataFrame([("1", "used", "Cafe", date(2026, 1, 1)), ("2", "active", "Cafe", date(2026, 1, 1))], "id string, status string, merchant string, expires_on date")
    today = F.lit(date(2026, 8, 1))
    assert registers.purge_selection(df, today, status=["used"], merchant="CAF", older_than_days=30).count() == 1
    with pytest.raises(LookupError):
        registers.purge_selection(df, today, ids=["1", "9"])
    paths = spark.createDataFrame([("/r/A/x",), ("/r/A/../B/x",), ("/r/AB/x",)], "p string")
    assert [r.o for r in paths.select(registers.owned(F.col("p"), "/r", F.lit("A")).alias("o")).collect()] == [True, False, False]


def test_configs(spark):
    text = '{\n// comment\n"sources": [{"name": "a", "url": "https://x//y", "category": "t"}, {"name": "b", "url": "http://z", "category": "u", "enabled": false}]}'
    found = config.sources(text)
    assert [s.name for s in config.select(found)] == ["a"] and config.source_dim(spark, found).count() == 2
    for bad in ('{"sources": [{"name": "a", "url": "ftp://x", "category": "t"}]}', '{"sources": [{"name": "a", "url": "http://x", "category": "t", "zzz": 1}]}', '{"sources": [{"name": "a", "url": "http://x", "category": "t", "kind": "html"}]}', "[1]", "{", text.replace('"b"', '"a"')):
        with pytest.raises(config.ConfigError):
            config.sources(bad)
    with pytest.raises(config.ConfigError):
        config.select(found, ["nope"])
    w = config.watchlist('{"tickers": [{"ticker": "nvda", "competitors": ["amd"], "extra": 1}], "sectors": [{"name": "s", "members": ["a", "b"]}]}')
    tickers, members = config.watchlist_dims(spark, w)
    assert tickers.first().competitors == ["AMD"] and members.count() == 2 and config.watchlist(w.to_json()) == w
    assert "enabled" not in w.to_json() and w.without("NVDA").tickers == ()
    with pytest.raises(config.ConfigError):
        config.watchlist('{"tickers": [{"ticker": "a"}, {"ticker": "A"}]}')
    scope = '{"scopes": [{"name": "x", "from_airport": "HKG", "to_airport": "DXB", "depart_from": "2026-12-01", "depart_to": "2026-12-03", "return_from": "2026-12-05", "return_to": "2026-12-06", "min_nights": 3}]}'
    assert config.scope_dim(spark, config.scopes(scope)).first().min_nights == 3
    with pytest.raises(config.ConfigError):
        config.scopes(scope, ["y"])
