"""Readers with declared schemas; what cannot be read goes to a rejects frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import parse_quarter, vendor_time
from ..functions.numbers import vendor_number, whole_number
from ..functions.text import decoded

QUARTERS = "quarter string, land_ready string, being_built string, built_not_sold string, total string"
RUNS = "at timestamp, status string, quarter string, pending int, overdue boolean, consecutive_failures int"
BARS = "ticker string, day date, open double, high double, low double, close double, adj_close double, volume double"
CANDIDATES = "account_id string, source struct<kind:string,media_sha256:string,raw_text:string>, coupon_count_stated int, candidates array<struct<merchant:string,title:string,expires_on:string,expiry_precision:string,expiry_assumed:boolean,uses_total:int,confidence:double,conditions:array<struct<kind:string,params:map<string,string>,text:string>>>>"


def quarters(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(quarters newest first, rejects) of a CSV read by position: header names are ignored."""
    raw = spark.read.schema(QUARTERS + ", _corrupt_record string").csv(path, header=True, enforceSchema=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return split_quarters(raw)


def split_quarters(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    names = ("land_ready", "being_built", "built_not_sold", "total")
    label = F.regexp_replace("quarter", "^﻿", "")
    typed = raw.select(F.trim(label).alias("quarter"), *[F.col(n).alias(f"{n}_text") for n in names], *[whole_number(F.col(n)).alias(n) for n in names], parse_quarter(F.trim(label)).alias("q_index"))
    bad = F.col("q_index").isNull()
    for n in names:
        bad = bad | F.col(n).isNull()
    good = typed.where(~bad).select("quarter", "q_index", *names).orderBy(F.desc("q_index"))
    return good, typed.where(bad)


def run_log(spark: SparkSession, path: str, limit: int = 20) -> DataFrame:
    """The newest runs of a JSON-lines log; broken lines are skipped."""
    return spark.read.schema(RUNS).json(path, mode="DROPMALFORMED").orderBy(F.desc("at")).limit(limit)


def without_comments(text: Column) -> Column:
    """JSON text without lines that are ``//`` comments as a whole; other lines keep their number."""
    return F.regexp_replace(text, r"(?m)^[ \t]*//.*$", "")


def commented_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.from_json(without_comments(F.col("value")), schema).alias("c")).select("c.*")


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """One row for each coupon of candidate documents, with its document's fields."""
    docs = spark.read.schema(CANDIDATES).json(path, multiLine=True)
    return docs.select("account_id", "source.*", F.col("coupon_count_stated").alias("stated"), F.size("candidates").alias("n_found"), F.posexplode("candidates").alias("at", "c")).select("*", "c.*").drop("c")


def bars(primary: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """Daily bars without gaps in their prices; the fallback's where the primary has none, marked degraded."""
    first = primary.withColumns({"source": F.lit("primary"), "priority": F.lit(0)})
    both = first if fallback is None else first.unionByName(fallback.withColumns({"source": F.lit("fallback"), "priority": F.lit(1)}), allowMissingColumns=True)
    whole = both.dropna(subset=["open", "high", "low", "close"]).withColumn("volume", F.coalesce("volume", F.lit(0.0)))
    rest = [c for c in whole.columns if c not in ("ticker", "day", "priority")]
    best = whole.groupBy("ticker", "day").agg(F.min(F.struct("priority", *rest)).alias("b"))
    return best.select("ticker", "day", *[f"b.{c}" for c in rest], (F.col("b.priority") > 0).alias("degraded"))


def fallback_csv(spark: SparkSession, path: str, ticker: str) -> DataFrame:
    raw = spark.read.schema("day date, open double, high double, low double, close double, volume double").csv(path, header=True, mode="DROPMALFORMED")
    return raw.withColumn("ticker", F.lit(ticker))


def since_last(rows: DataFrame, stored: DataFrame, key: str = "ticker", day: str = "day") -> DataFrame:
    """Rows from each key's last stored day on, itself included less one, for it may have been provisional."""
    last = stored.groupBy(key).agg(F.date_sub(F.max(day), 1).alias("__from"))
    return rows.join(last, key, "left").where(F.col("__from").isNull() | (F.col(day) >= F.col("__from"))).drop("__from")


def batch_status(results: DataFrame, group: str) -> DataFrame:
    """ok, partial, error or skipped of each batch (``failed`` boolean of its members)."""
    per = results.groupBy(group).agg(F.count("*").alias("n"), F.count_if("failed").alias("n_failed"))
    return per.withColumn("status", F.when(F.col("n") == 0, "skipped").when(F.col("n_failed") == 0, "ok").when(F.col("n_failed") == F.col("n"), "error").otherwise("partial"))


def first_key(payload: Column, *names: str) -> Column:
    """The first of several keys that a JSON payload has."""
    return F.coalesce(*[F.get_json_object(payload, f"$.{n}") for n in names])


def mixed_date(value: Column) -> Column:
    """A date from epoch seconds, ISO text or the first of a JSON list."""
    one = F.coalesce(F.get_json_object(value, "$[0]"), value)
    return F.coalesce(F.when(one.rlike(r"^\d{9,11}$"), F.timestamp_seconds(one.cast("long")).cast("date")), F.try_to_date(F.substring(one, 1, 10)))


def newest_observation(payloads: DataFrame) -> DataFrame:
    """series, as_of and value: the newest usable observation of a vendor's JSON (``.`` is missing)."""
    obs = payloads.select("series", F.explode(F.from_json("payload", "struct<data:array<struct<date:string,value:string>>>")["data"]).alias("o"))
    typed = obs.select("series", F.try_to_date("o.date").alias("as_of"), vendor_number(F.col("o.value")).alias("value")).where("value is not null and as_of is not null")
    return typed.groupBy("series").agg(F.max("as_of").alias("as_of"), F.max_by("value", "as_of").alias("value"))


YAHOO = "struct<contentType:string,title:string,summary:string,pubDate:string,provider:struct<displayName:string>,canonicalUrl:struct<url:string>,clickThroughUrl:struct<url:string>>"
VANTAGE = "struct<title:string,url:string,source:string,summary:string,time_published:string,ticker_sentiment:array<struct<ticker:string,relevance_score:string,ticker_sentiment_score:string,ticker_sentiment_label:string>>>"


def nested_news(raw: DataFrame) -> DataFrame:
    """Stories of the nested (or flat) feed: other content types, and items without title or url, are left out."""
    c = F.coalesce(F.from_json(F.get_json_object("payload", "$.content"), YAHOO), F.from_json("payload", YAHOO))
    items = raw.withColumn("c", c)
    url = F.coalesce("c.canonicalUrl.url", "c.clickThroughUrl.url")
    out = items.select("ticker", "peer_of", F.trim("c.title").alias("title"), url.alias("url"), F.coalesce(F.nullif(F.trim("c.provider.displayName"), F.lit("")), F.lit("Yahoo Finance")).alias("source"), vendor_time(F.col("c.pubDate")).alias("published_at"), F.nullif(F.trim("c.summary"), F.lit("")).alias("summary"), F.col("c.contentType").alias("kind"), F.lit("yahoo").alias("feed"))
    return out.where((F.coalesce("kind", F.lit("STORY")) == "STORY") & (F.coalesce("title", F.lit("")) != "") & F.col("url").isNotNull()).drop("kind")


def scored_news(raw: DataFrame) -> DataFrame:
    """Stories of the scored feed: the subject is the most relevant ticker; scores are those of the asked ticker."""
    items = raw.withColumn("c", F.from_json("payload", VANTAGE)).where("c.title is not null and c.url is not null")
    relevance = lambda s: F.coalesce(s["relevance_score"].try_cast("double"), F.lit(0.0))
    ranked = F.array_sort("c.ticker_sentiment", lambda a, b: F.when(relevance(a) > relevance(b), -1).when(relevance(a) < relevance(b), 1).otherwise(0))
    out = items.withColumn("r", ranked).withColumn("mine", F.get(F.filter("r", lambda s: s["ticker"] == F.col("ticker")), F.lit(0)))
    return out.select(
        "ticker", "peer_of", F.trim("c.title").alias("title"), F.trim("c.url").alias("url"), F.coalesce(F.nullif(F.trim("c.source"), F.lit("")), F.lit("Alpha Vantage")).alias("source"),
        vendor_time(F.col("c.time_published")).alias("published_at"), F.nullif(F.trim("c.summary"), F.lit("")).alias("summary"), F.lit("alphavantage").alias("feed"),
        F.col("mine.ticker_sentiment_score").try_cast("double").alias("sentiment_score"), F.col("mine.ticker_sentiment_label").alias("sentiment_label"), F.col("mine.relevance_score").try_cast("double").alias("relevance"),
        F.coalesce(F.get("r", F.lit(0))["ticker"] == F.col("ticker"), F.lit(False)).alias("is_subject"),
    )


def refused(payloads: DataFrame) -> DataFrame:
    """Payloads that are a vendor's note instead of data: failures, though the transport said otherwise."""
    note = first_key(F.col("payload"), "Information", "Note", "Error Message")
    return payloads.withColumn("note", note).where(F.col("note").isNotNull() | ~F.trim("payload").rlike(r"(?s)^[\[{]"))


def feed_requests(tickers: DataFrame) -> DataFrame:
    """What to ask for: each ticker itself, and its competitors (ticker, competitors array)."""
    own = tickers.select("ticker", F.col("ticker").alias("symbol"), F.lit(None).cast("string").alias("peer_of"))
    peers = tickers.select("ticker", F.explode("competitors").alias("symbol")).select("ticker", "symbol", F.col("symbol").alias("peer_of"))
    return own.unionByName(peers)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def file_anomalies(files: DataFrame, media: DataFrame) -> DataFrame:
    """Files no media row names, and media rows whose file is gone."""
    extra = files.join(media.select("path"), "path", "left_anti").select("path", F.lit("orphan").alias("kind"))
    gone = media.join(files.select("path"), "path", "left_anti").select("path", F.lit("missing").alias("kind"))
    return extra.unionByName(gone)


def trailing_days(rows: DataFrame, key: str, day: str, days: int) -> DataFrame:
    """Each key's rows within some days of its newest."""
    newest = rows.groupBy(key).agg(F.date_sub(F.max(day), days).alias("__from"))
    return rows.join(newest, key).where(F.col(day) >= F.col("__from")).drop("__from")


def fallback_symbol(ticker: Column) -> Column:
    """A ticker as the fallback source spells it: home listings end in ``.us``, dots in a class are dashes; others are not there."""
    low = F.lower(F.trim(ticker))
    foreign = low.rlike(r"\.(hk|ss|sz|t|l)$")
    return F.when(~foreign, F.concat(F.replace(low, F.lit("."), F.lit("-")), F.lit(".us")))


def tolerant_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with broken ones left out: a damaged ledger file reads as what is left of it."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def corporate_calendar(payloads: DataFrame) -> DataFrame:
    """Earnings and ex-dividend dates of a vendor's calendar (ticker, payload), a row for each that is known."""
    earnings = first_key(F.col("payload"), "'Earnings Date'", "earningsDate")
    dividend = first_key(F.col("payload"), "'Ex-Dividend Date'", "exDividendDate")
    each = F.array(F.struct(F.lit("earnings").alias("kind"), mixed_date(earnings).alias("event_date")), F.struct(F.lit("ex_dividend").alias("kind"), mixed_date(dividend).alias("event_date")))
    return payloads.select("ticker", F.explode(each).alias("e")).select("ticker", "e.*").where("event_date is not null")


def chart_frame(rows: DataFrame) -> DataFrame:
    """Bars in the columns that a chart wants, oldest first."""
    return rows.select(F.col("day").alias("Date"), F.col("open").alias("Open"), F.col("high").alias("High"), F.col("low").alias("Low"), F.col("close").alias("Close"), F.col("volume").alias("Volume")).orderBy("Date")


LANDED = "url string, attempt int, status int, charset string, etag string, last_modified string, body binary, fetched_at timestamp"


def landed(spark: SparkSession, path: str) -> DataFrame:
    """Responses that a fetcher left in a landing folder, one JSON line for each attempt (the body in base 64)."""
    schema = LANDED.replace("body binary", "body string")
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED").withColumn("body", F.unbase64("body"))


def conditional_responses(attempts: DataFrame, known: DataFrame, retries: int = 2) -> DataFrame:
    """What each address gave: fresh text, unchanged, or a failure and why.

    ``attempts`` as ``landed`` has them, ``known`` (url, etag, last_modified) what was
    sent along. Only a server's error (500 and over, or no status) is tried again, up
    to ``retries`` times more: the first other answer counts. Unchanged addresses keep
    their validators, fresh ones have those of the answer.
    """
    again = F.coalesce(F.col("status"), F.lit(500)) >= 500
    answer = F.struct(again.alias("again"), "attempt", "status", "charset", "etag", "last_modified", "body", "fetched_at")
    last = attempts.where(F.col("attempt") <= retries).groupBy("url").agg(F.min(answer).alias("first"), F.max(F.when(again, answer)).alias("failed"))
    a = F.when(F.col("first.again"), F.col("failed")).otherwise(F.col("first"))
    picked = last.select("url", a.alias("a")).join(known.select("url", F.col("etag").alias("had_etag"), F.col("last_modified").alias("had_modified")), "url", "left")
    outcome = F.when(F.col("a.status") == 304, "unchanged").when(F.col("a.status").between(200, 299), "fresh").otherwise("failed")
    kept = outcome == "unchanged"
    return picked.select(
        "url", outcome.alias("outcome"), F.when(outcome == "fresh", decoded(F.col("a.body"), F.col("a.charset"))).alias("text"),
        F.when(kept, F.col("had_etag")).otherwise(F.col("a.etag")).alias("etag"), F.when(kept, F.col("had_modified")).otherwise(F.col("a.last_modified")).alias("last_modified"),
        F.when(outcome == "failed", F.concat(F.lit("HTTP "), F.coalesce(F.col("a.status").cast("string"), F.lit("none")), F.lit(" after "), (F.col("a.attempt") + 1).cast("string"), F.lit(" attempts"))).alias("problem"), F.col("a.fetched_at").alias("fetched_at"),
    )


def documents_checked(spark: SparkSession, path: str) -> DataFrame:
    """Landed PDF files by their first bytes: path, length, and whether each is one."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", (F.substring("content", 1, 4) == F.lit(b"%PDF")).alias("is_pdf"))


def stale_files(spark: SparkSession, path: str, now: Column, days: int, pattern: str = "*.png") -> DataFrame:
    """Files of a folder (not of those under it) last changed more than ``days`` before ``now``: a retention sweep's list. Contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length", F.col("modificationTime").alias("modified_at"))
    return files.where(F.col("modified_at") < now - F.make_dt_interval(days=F.lit(days)))
