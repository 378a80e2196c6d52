import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerline.sources import config
from ledgerline.workspace import Workspace

NOW = datetime(2026, 8, 5, 12)


@pytest.fixture()
def ws(spark, tmp_path):
    return Workspace(spark, str(tmp_path))


def test_spending(ws, spark):
    ws.spending.init(commit=True)
    assert ws.spending.init(commit=True).count() == 0  # nothing twice
    ws.spending.alias("Al", "Alice", commit=True)
    sent = spark.createDataFrame([("1", "al", "haircut $300; dinner $50", "2026-07-31T17:10:00Z"), ("2", "Bob", "bubble tea $20", "2026-07-19T21:30:00"), ("3", "Bob", "no amount", "2026-07-19T21:30:00")], "message_id string, member string, text string, sent string")
    assert ws.spending.add(sent).count() == 3 and ws.spending.list().count() == 0  # a dry run
    assert ws.spending.add(sent, commit=True).count() == 3
    assert ws.spending.add(sent, commit=True).count() == 0
    august = ws.spending.query("2026-08")
    assert august["total"].first().total == 350.0 and august["by_member"].first().member == "Alice"
    assert [r.keyword for r in ws.spending.unmapped().collect()] == [] and ws.spending.query("2026-07")["by_category"].first().category == "Food & Drinks"
    good, bad = ws.spending.learn(spark.createDataFrame([("bubble tea", "Other"), ("x", "Nope")], "keyword string, category string"), commit=True)
    assert good.count() == 1 and bad.count() == 1
    assert ws.spending.year("2026").count() == 3 and ws.spending.report("2026-08")["currency"].first().currency == "HKD"
    gone = ws.spending.list(limit=1).first().id
    assert ws.spending.delete([gone], commit=True).count() == 2


def test_vouchers(ws, spark):
    good, refused = ws.vouchers.add_accounts(spark.createDataFrame([("A", "Alice", "1001"), ("B", "Bob", None)], "account_id string, name string, chat_id string"), commit=True)
    assert good.count() == 2 and refused.count() == 0
    again, refused = ws.vouchers.add_accounts(spark.createDataFrame([("C", "Carl", "1001")], "account_id string, name string, chat_id string"), commit=True)
    assert again.count() == 0 and refused.count() == 1
    row = lambda at, title, conf, kind="other": ("A", "d1", at, 3, "Cafe", title, date(2026, 8, 6), conf, False, 2, [(kind, {}, None)], "text")
    cand = spark.createDataFrame([row(0, "$20 off", 0.9), row(1, "$30 off", 0.5), row(2, "$40 off", 0.9)], "account_id string, doc string, at int, stated int, merchant string, title string, expires_on date, confidence double, assumed boolean, uses_total int, conditions array<struct<kind:string,params:map<string,string>,text:string>>, source_kind string")
    added, bad = ws.vouchers.commit_candidates(cand, F.lit(NOW).cast("timestamp"), commit=True)
    assert added.count() == 3 and bad.count() == 0
    assert {r.title: r.status for r in ws.vouchers.current().collect()} == {"$20 off": "active", "$30 off": "needs_review", "$40 off": "active"}
    assert ws.vouchers.commit_candidates(cand, F.lit(NOW).cast("timestamp"), commit=True)[0].count() == 0
    ident = {r.title: r.id for r in ws.vouchers.current().collect()}
    assert ws.vouchers.act("A", ident["$20 off"], "use", NOW, commit=True).first().uses_remaining == 1
    with pytest.raises(LookupError):
        ws.vouchers.act("B", ident["$20 off"], "use", NOW)
    assert ws.vouchers.review("A").count() == 1
    ws.vouchers.act("A", ident["$30 off"], "resolve", NOW + timedelta(minutes=1), "active", commit=True)
    assert ws.vouchers.review("A").count() == 0
    today = F.lit(NOW.date())
    assert ws.vouchers.usable_now("A", F.lit(NOW).cast("timestamp_ntz")).count() == 3 and ws.vouchers.usable_now("B", F.lit(NOW).cast("timestamp_ntz")).count() == 0
    assert ws.vouchers.alerts_due(today).first().n == 3
    later = NOW + timedelta(days=3)
    assert ws.vouchers.sweep_expiry(later, commit=True).count() == 3 and ws.vouchers.sweep_expiry(later, commit=True).count() == 0
    extended = ws.vouchers.act("A", ident["$20 off"], "extend", later + timedelta(minutes=1), "2026-12-01", commit=True).first()
    assert extended.status == "active" and extended.expires_on == date(2026, 12, 1)
    ws.vouchers.purge("A", today, status=["expired"], commit=True)
    assert ws.vouchers.current().count() == 1 and ws.vouchers.doctor()["orphans"].count() == 0 and ws.vouchers.list("A", today).count() == 1


def test_supply(ws, spark):
    q = lambda *rows: spark.createDataFrame(rows, "quarter string, land_ready int, being_built int, built_not_sold int, total int")
    ws.supply.check(q(("2025/Dec", 1, 2, 3, 6), ("2026/Mar", 2, 2, 3, None)), NOW, commit=True)
    good, refused = ws.supply.check(q(("2026/Jun", 3, 2, 3, None), ("2026/Mar", 9, 9, 9, None)), NOW, commit=True)
    assert [r.quarter for r in good.collect()] == ["2026/Jun"] and refused.count() == 1
    assert [r.quarter for r in ws.supply.pending().collect()] == ["2026/Jun"]
    assert ws.supply.report(NOW).first().quarter == "2026/Jun" and ws.supply.pending().count() == 1  # a dry run stamps nothing
    assert ws.supply.report(NOW, commit=True).first().delta == 1 and ws.supply.pending().count() == 0
    assert ws.supply.history(2).count() == 2


def feed(*titles):
    return "<rss>" + "".join(f"<item><title>{t}</title><link>/{abs(hash(t))}</link></item>" for t in titles) + "</rss>"


def test_radar(ws, spark):
    sources = config.sources(json.dumps({"sources": [{"name": "a", "url": "https://a.example", "category": "tech"}, {"name": "b", "url": "https://b.example", "category": "tech"}]}))
    pages = lambda **bodies: spark.createDataFrame([(k, f"https://{k}.example", v) for k, v in bodies.items()], "source string, url string, body string")
    assert ws.radar.scan(pages(a=feed("old one", "old two")), sources, NOW, commit=True).count() == 2
    assert ws.radar.digest(sources, NOW).count() == 0  # the first harvest is no news
    later = NOW + timedelta(hours=1)
    ws.radar.scan(pages(a=feed("old one", "gamma launches delta engine"), b=feed("first of b")), sources, later, commit=True)
    latest = NOW + timedelta(hours=2)
    ws.radar.scan(pages(b=feed("gamma launches the delta engine", "sponsored thing")), sources, latest, exclude=["sponsored"], commit=True)
    told = ws.radar.digest(sources, latest, commit=True).collect()
    assert len(told) == 1 and told[0].n == 2 and told[0].n_sources == 2
    assert ws.radar.digest(sources, latest).count() == 0 and ws.radar.items(2).count() == 2
    assert {r.source: r.recent_yield for r in ws.radar.sources(sources).collect()} == {"a": 2, "b": 1}
    assert ws.runs("scan").count() == 3


def test_fares(ws, spark):
    c = "run_date date, scope string, origin string, dest string, depart_date date, return_date date, airline string, dep_bucket string, ret_bucket string, out_stops int, ret_stops int, seat string, currency string, min_price double, n_itineraries long"
    cell = lambda d, price, airline="CX": (date(2026, 11, d), "s", "HKG", "DXB", date(2026, 12, 1), date(2026, 12, 9), airline, "09-12", "12-15", 0, 0, "economy", "HKD", price, 1)
    ws.fares.collect(spark.createDataFrame([cell(1, 6500.0), cell(8, 6000.0), cell(8, 7000.0, "EK")], c), commit=True)
    ws.fares.collect(spark.createDataFrame([cell(8, 5900.0)], c), commit=True)
    r = ws.fares.report("s", date(2026, 11, 8))
    assert r["ranking"].first().price == 5900.0 and r["drops"].first().delta == -600.0 and r["rises"].count() == 0
    assert ws.fares.latest().count() == 2 and ws.fares.trend("s", date(2026, 11, 2)).count() == 2


def test_desk(ws, spark):
    watch = config.watchlist('{"tickers": [{"ticker": "ACME", "company_name": "Acme Inc"}, {"ticker": "0700.HK"}], "sectors": [{"name": "s", "members": ["ACME", "0700.HK"]}]}')
    bars = spark.createDataFrame([("ACME", date(2026, 7, d), 1.0, 2.0, 1.0, 1.0 + d, 9.0) for d in range(1, 20)], "ticker string, day date, open double, high double, low double, close double, volume double")
    ws.desk.sync(bars, commit=True)
    assert ws.desk.sync(bars.limit(3), commit=True).count() == 19
    added, refused = ws.desk.trade(spark.createDataFrame([(1, "ACME", date(2026, 7, 1), "buy", 10.0, 5.0, 0.0), (2, "ACME", date(2026, 7, 2), "buy", -1.0, 5.0, 0.0)], "id long, ticker string, trade_date date, side string, quantity double, price double, fee double"), commit=True)
    assert added.count() == 1 and refused.count() == 1 and ws.desk.positions().first().market_value == 200.0
    item = lambda n, t: ("ACME", None, f"https://n.example/{n}", t, "CNBC")
    news = lambda *rows: spark.createDataFrame(list(rows), "ticker string, peer_of string, url string, title string, source string")
    assert ws.desk.poll(news(item(1, "Acme beats estimates")), watch, NOW, commit=True).count() == 1
    assert ws.desk.pending(F.lit(NOW.date())).first().news == 0  # a ticker's first batch is absorbed
    ws.desk.poll(news(item(1, "Acme beats estimates"), item(2, "Acme to acquire Beta"), item(3, "Other wins contract"), item(4, "Acme stock rises")), watch, NOW + timedelta(hours=1), commit=True)
    ws.desk.refresh_events(spark.createDataFrame([("ACME", "earnings", date(2026, 8, 10))], "ticker string, kind string, event_date date"), commit=True)
    m = lambda d, v: ("ust_2y", date(2026, 8, d), v, NOW)
    ws.desk.refresh_macro(spark.createDataFrame([m(1, 4.0)], "series string, as_of date, value double, fetched_at timestamp"), commit=True)
    ws.desk.seed_macro(NOW, commit=True)
    ws.desk.refresh_macro(spark.createDataFrame([m(2, 4.2)], "series string, as_of date, value double, fetched_at timestamp"), commit=True)
    moves = spark.createDataFrame([("ust_2y", 0.1)], "series string, move double")
    stories, due = ws.desk.alerts(F.lit(NOW.date()))
    assert stories.first().score == 48 + 12 + 15 and due.count() == 1
    made = ws.desk.report(watch, moves, NOW, commit=True)
    assert ws.desk.pending(F.lit(NOW.date())).first().pending == 0
    again = ws.desk.report(watch, moves, NOW)
    assert again.capped.count() == 0 and again.events.count() == 0 and again.macro.count() == 0 and made.status_lines.count() == 1
    assert ws.desk.scan(commit=True).first().reason == "insufficient_history" and ws.table("setup_state").count() == 1
    assert ws.desk.sector(watch)[0].first().cohesion == "unknown" and ws.desk.macro()["latest"].first().value == 4.2
    assert {r.market for r in ws.desk.schedule(watch, F.lit(NOW.date())).collect()} == {"US", "HK"}
    assert ws.desk.brief("ACME", F.lit(NOW).cast("timestamp") - F.expr("interval 1 day"), F.lit(NOW.date()))["news"].count() == 3
