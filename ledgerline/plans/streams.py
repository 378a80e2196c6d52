"""Streams run to their end over the driver's tables: their results must equal the batch ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import Versioned
from ..session import read
from ..sources import landing, readers
from ..staging import staging_path
from ..streaming import ingest
from . import adapters as a
from . import market
from .registry import query


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as a stream of its files."""
    return ingest.landing(spark, f"{sf}/events*.parquet", read(spark, sf, "events").schema)


def _final(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """The complete result after the last batch, as a table."""
    at = staging_path(spark, "stream")
    query = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{at}/out")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


@query("select date_trunc('day', ts) as start, date_trunc('day', ts) + interval 1 day as \"end\", event_type, count(*) as n, cast(sum(cast(value as decimal(38,2))) as double) as total from events group by 1, 2, 3")
def stream_tumbling(spark, sf):
    out = _final(spark, ingest.tumbling(_events(spark, sf), "ts", "1 day", ["event_type"], "value", "60 days"))
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


@query("with e as (select user_id, ts, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 6 hour or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end as s from events), g as (select user_id, ts, sum(s) over (partition by user_id order by ts) as k from e) select user_id, min(ts) as start, max(ts) + interval 6 hour as \"end\", count(*) as n from g group by user_id, k")
def stream_sessions(spark, sf):
    out = _final(spark, ingest.sessions(_events(spark, sf), "ts", "6 hours", ["user_id"], "60 days"))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("select event_id, event_type, value from events")
def stream_ingest(spark, sf):
    """Ingested twice: the second time adds nothing."""
    at = staging_path(spark, "stream")
    table = Versioned(spark, f"{at}/table", "event_id long, event_type string, value double", ["event_id"])
    for n in range(2):
        ingest.into(_events(spark, sf), f"{at}/checkpoint{n}", ingest.absent_into(table, ["event_id"]))
    return table.read()


def _stateful(spark: SparkSession, stream: DataFrame, mode: str, at: str) -> DataFrame:
    """All rows that a stream with own state has emitted, with the number of their batch."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        step = lambda df, n: df.withColumn("batch", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{at}/out/batch-{n}")
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(step).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)
    return spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{at}/out/batch-*")


@query(a.with_views(market._MATCHED, market.T))
def stream_positions(spark, sf):
    """Trades in three deliveries, by date: open lots are state, and each ticker's last row is its position."""
    at = staging_path(spark, "positions")
    trades = a.trades(spark, sf)
    cuts = trades.agg(F.percentile_approx(F.unix_date("trade_date"), [1 / 3, 2 / 3])).first()[0]
    day, third = F.unix_date("trade_date"), F.lit(0)
    for cut in cuts or []:
        third = third + (day > cut).cast("int")
    # A delivery is as many files as tasks wrote, and one batch: the stream ends with it, and goes on with the next.
    for k in range(3):
        trades.where(third == k).write.mode("append").parquet(f"{at}/in")
        rows = _stateful(spark, ingest.positions(ingest.landing(spark, f"{at}/in", trades.schema, files_per_batch=2**31 - 1)), "update", at)
    last = rows.groupBy("ticker").agg(F.max_by(F.struct("quantity", "avg_cost", "cost_basis", "realized"), "batch").alias("p")).select("ticker", "p.*")
    return market._cents(last)


@query("with c as (select s_suppkey as id, timestamp '2024-01-01 00:30:00' + to_hours(s_suppkey) as began, 1 + s_suppkey % 20 as days, s_suppkey % 3 = 0 as used from supplier) select id, case when used then 'used' when began + to_days(cast(days as integer)) <= (select max(case when used then began + to_hours(12) else began end) from c) - interval 1 hour then 'expired' else 'active' end as status from c")
def stream_expiries(spark, sf):
    """Coupons that are used, or expire when the watermark passes their end, or stay: each one's last status."""
    at = staging_path(spark, "expiries")
    start = F.expr("timestamp_ntz'2024-01-01 00:30:00' + make_dt_interval(0, int(s_suppkey))")
    c = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), start.alias("at"))
    added = c.select("id", "at", F.lit(0).cast("long").alias("seq"), F.lit("add").alias("kind"), F.expr("cast(at as timestamp) + make_dt_interval(int(1 + id % 20))").alias("until"))
    used = c.where("id % 3 = 0").select("id", F.expr("at + make_dt_interval(0, 12)").alias("at"), F.lit(1).cast("long").alias("seq"), F.lit("use").alias("kind"), F.lit(None).cast("timestamp").alias("until"))
    events = added.unionByName(used).withColumn("id", F.col("id").cast("string"))
    events.coalesce(1).write.parquet(f"{at}/in")
    rows = _stateful(spark, ingest.expiries(ingest.landing(spark, f"{at}/in", events.schema)), "append", at)
    return rows.groupBy(F.col("id").cast("long").alias("id")).agg(F.max_by("status", F.struct("at", F.col("status") != "active")).alias("status"))


@query(a.with_views("select id, member, case when id % 1000 = 7 then 'new' else category end as category, cast(amount as double) as amount from v_expenses union all select -1, 'x', 'new', 0.0", "v_expenses"))
def merge_files(spark, sf):
    """A merge into a table of many files, of which only those with a key of the updates are written anew."""
    e = a.expenses(spark, sf).select("id", "member", "category", "amount").withColumn("amount", F.col("amount").cast("double"))
    table = Versioned(spark, staging_path(spark, "merge-files"), "id long, member string, category string, amount double", ["id"])
    table.commit(e.withColumn("id", F.col("id").cast("long")).repartitionByRange(16, "id"))
    fresh = e.where("id % 1000 = 7").withColumns({"category": F.lit("new"), "member": F.lit("x")})
    fresh = fresh.unionByName(spark.range(1).selectExpr("-1L as id", "'x' as member", "'new' as category", "0D as amount"))
    table.merge(fresh, keep=["member"])
    return table.read()


@query(a.with_views(", m as (select series, as_of, value, row_number() over (partition by series order by as_of) as i from v_macro), w as (select series, as_of, value, i from m) select series, count(*) as n_days, max(value) - min(value) > 40 as moved from w group by 1", "v_macro"))
def macro_days(spark, sf):
    m = a.macro(spark, sf)
    return m.groupBy("series").agg(F.count("*").alias("n_days"), (F.max("value") - F.min("value") > 40).alias("moved"))


def _fetched(spark: SparkSession, sf: str, round_: int) -> DataFrame:
    """Attempts to fetch every page in one of two rounds, as the wire gives them; the remainder of the id by 5 says what happens."""
    kind, page = F.col("page_id") % 5, F.coalesce("html", F.lit(""))
    etag = F.concat(F.lit('"'), F.lit(f"r{round_}-"), F.col("page_id").cast("string"), F.lit('"'))
    body = F.when(F.lit(round_ == 1), page).otherwise(F.concat(F.lit("again "), page))
    ok = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nETag: "), etag, F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body)
    bare = lambda status: F.lit(f"HTTP/1.1 {status} x\r\nContent-Length: 0\r\n\r\n")
    if round_ == 1:
        tries = F.when(kind == 0, F.array(bare(503), ok)).when(kind == 1, F.array(bare(404))).when(kind == 2, F.array(bare(500), F.lit(""), bare(503))).otherwise(F.array(ok))
    else:
        tries = F.when(kind.isin(0, 3), F.array(bare(304))).when(kind == 2, F.array(F.lit(""), ok)).otherwise(F.array(ok))
    url = F.concat("url", F.lit("#"), F.col("page_id").cast("string"))
    # A round lasts a day, however many pages it fetches.
    began = F.expr(f"timestamp'2024-01-0{round_} 00:00:00Z' + make_dt_interval(0, 0, 0, pmod(page_id, 86400))")
    each = read(spark, sf, "pages").select("page_id", url.alias("url"), began.alias("fetched_at"), F.posexplode(tries).alias("attempt", "r"))
    return each.select("url", "attempt", "fetched_at", F.encode("r", "utf-8").alias("response"))


def _landed(spark: SparkSession, sf: str, label: str) -> str:
    """Both rounds in a landing folder, by two fetchers."""
    landing.register(spark)
    at = staging_path(spark, label)
    for n, fetcher in ((1, "north"), (1, "south"), (2, "north"), (2, "south")):
        own = F.crc32("url") % 2 == (0 if fetcher == "north" else 1)
        _fetched(spark, sf, n).where(own).write.format("landed_responses").option("fetcher", fetcher).mode("append").save(f"{at}/landing")
    return at


_FETCHES = "p as (select page_id % 5 as kind, url || '#' || cast(page_id as varchar) as url, coalesce(html, '') as html, '\"r1-' || cast(page_id as varchar) || '\"' as e1, '\"r2-' || cast(page_id as varchar) || '\"' as e2, page_id from pages)"


@query(f"with {_FETCHES} select url, case when kind in (0, 3) then 'unchanged' else 'fresh' end as outcome, case when kind not in (0, 3) then md5('again ' || html) end as text_md5, case when kind in (0, 3) then e1 else e2 end as etag from p")
def landed_answers(spark, sf):
    """Every page's second fetch, read from the landing folder, against the validators of the first."""
    at = _landed(spark, sf, "answers")
    attempts = spark.read.format("landed_responses").load(f"{at}/landing")
    second = F.col("fetched_at") >= F.lit("2024-01-02 00:00:00Z").cast("timestamp")
    none = spark.createDataFrame([], "url string, etag string, last_modified string")
    known = readers.conditional_responses(attempts.where(~second), none).where("outcome = 'fresh'").select("url", "etag", "last_modified")
    return readers.conditional_responses(attempts.where(second), known).select("url", "outcome", F.md5("text").alias("text_md5"), "etag")


@query(f"with {_FETCHES} select url, cast(1 as integer) as turn, case when kind in (1, 2) then 'failed' else 'fresh' end as outcome, case when kind not in (1, 2) then md5(html) end as text_md5, case when kind not in (1, 2) then e1 end as etag from p union all select url, 2, case when kind in (0, 3) then 'unchanged' else 'fresh' end, case when kind not in (0, 3) then md5('again ' || html) end, case when kind in (0, 3) then e1 else e2 end from p")
def stream_answers(spark, sf):
    """Both fetches of every page, the landing folder read as a stream with the validators as state."""
    at = _landed(spark, sf, "stream-answers")
    rows = _stateful(spark, ingest.answers(spark.readStream.format("landed_responses").load(f"{at}/landing")), "append", at)
    turn = F.when(F.col("fetched_at") >= F.lit("2024-01-02 00:00:00Z").cast("timestamp"), 2).otherwise(1)
    return rows.select("url", turn.alias("turn"), "outcome", F.md5("text").alias("text_md5"), "etag")
