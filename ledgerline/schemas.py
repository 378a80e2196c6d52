"""Declared schemas; nothing is inferred."""

from __future__ import annotations

TABLES = {
    "expenses": "id long, member string, description string, keyword string, category string, amount double, currency string, ts timestamp_ntz, ts_utc timestamp, message_id string, item_index int, source_text string",
    "keyword_category": "keyword string, category string, source string, hits long, created_at timestamp, updated_at timestamp",
    "account": "account_id string, name string, chat_id string, created_at timestamp",
    "coupon": "id string, account_id string, merchant string, title string, code string, value_text string, expires_on date, expiry_precision string, expiry_assumed boolean, status string, uses_total int, uses_remaining int, conditions array<struct<kind:string,params:map<string,string>,text:string>>, notes string, raw_text string, source_kind string, source_ref string, media_id string, extraction_confidence double, dedupe_key string, created_at timestamp, updated_at timestamp, used_at timestamp, expired_at timestamp",
    "media": "media_id string, account_id string, sha256 string, path string, mime string, bytes long, created_at timestamp",
    "quarters": "quarter string, q_index int, land_ready int, being_built int, built_not_sold int, total int",
    "ledger": "domain string, key string, stamped_at timestamp",
    "runs": "id long, kind string, started_at timestamp, finished_at timestamp, status string, detail string",
    "item": "id long, source string, item_key string, url string, title string, summary string, detail_text string, date_text string, source_domain string, first_seen_at timestamp, run_id long",
    "site_state": "source string, last_scan_at timestamp, etag string, recent_yield int, failures int",
    "cell": "run_date date, scope string, origin string, dest string, depart_date date, return_date date, airline string, return_airline string, dep_bucket string, ret_bucket string, out_stops int, ret_stops int, seat string, currency string, min_price double, n_itineraries long, created_at timestamp",
    "itinerary": "run_date date, scope string, origin string, dest string, depart_date date, return_date date, out_airline string, ret_airline string, out_depart timestamp_ntz, out_arrive timestamp_ntz, ret_depart timestamp_ntz, ret_arrive timestamp_ntz, out_stops int, ret_stops int, seat string, currency string, price double",
    "bars": "ticker string, day date, open double, high double, low double, close double, adj_close double, volume double, source string",
    "trades": "id long, ticker string, trade_date date, side string, quantity double, price double, fee double, note string",
    "news": "id long, ticker string, peer_of string, url_hash string, url string, title string, source string, published_at timestamp, first_seen_at timestamp, notified_at timestamp, feed string, summary string, sentiment_score double, sentiment_label string, relevance double, event_class string, materiality int, band string, suppressed boolean",
    "macro": "series string, as_of date, value double, fetched_at timestamp, notified_at timestamp",
    "events": "id long, ticker string, kind string, event_date date, detail string, detected_at timestamp, notified_at timestamp",
    "alias": "alias string, member string",
    "coupon_events": "id string, account_id string, at timestamp_ntz, seq long, kind string, arg string",
    "fundamentals": "ticker string, payload string, fetched_at timestamp",
    "setup_state": "ticker string, as_of date, stage string, score int, pivot double",
}

#: The natural key of each table: what an upsert matches on.
KEYS = {
    "expenses": ("message_id", "item_index"), "keyword_category": ("keyword",), "account": ("account_id",), "coupon": ("id",), "media": ("account_id", "sha256"), "quarters": ("quarter",), "ledger": ("domain", "key"), "runs": ("id",), "item": ("source", "item_key"), "site_state": ("source",),
    "cell": ("run_date", "scope", "origin", "dest", "depart_date", "return_date", "airline", "dep_bucket", "ret_bucket", "out_stops", "ret_stops"),
    "itinerary": ("run_date", "scope", "origin", "dest", "depart_date", "return_date", "out_airline", "ret_airline", "out_depart", "ret_depart"),
    "bars": ("ticker", "day"), "trades": ("id",), "news": ("ticker", "url_hash"), "macro": ("series", "as_of"), "events": ("ticker", "kind", "event_date"), "setup_state": ("ticker",),
    "alias": ("alias",), "coupon_events": ("id", "seq"), "fundamentals": ("ticker",),
}
#: Columns that an upsert leaves as they were first written.
KEPT = {"cell": ("created_at",), "macro": ("value", "notified_at"), "keyword_category": ("created_at",)}
#: Keys that hold nulls repeat freely.
FREE_NULLS = ("expenses",)
