"""Throttling, staleness, source state and seeding over the shop's tables: a client stands for a source, its sales for what a scan yields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scans, state
from ..session import read
from ..sources import readers
from . import reports
from .registry import query

_NOW, _CUT = "2024-04-29 06:00:00", "2024-03-01 00:00:00"


def _at(text: str):
    return F.lit(text).cast("timestamp_ntz")


def _source(column: str = "client_id"):
    return F.coalesce(F.col(column), F.lit(-1)).alias("source")


_SEEN = "s as (select coalesce(client_id, -1) as source, max(ts) as last_scan_at from clicks group by 1), c as (select distinct coalesce(client_id, -1) as source from clients)"


@query(f"with {_SEEN} select source, last_scan_at, cast(30 + source % 600 as integer) as min_interval_minutes, last_scan_at + to_minutes(cast(30 + source % 600 as integer)) as until from c join s using (source) where last_scan_at + to_minutes(cast(30 + source % 600 as integer)) > timestamp '{_NOW}'")
def scan_throttle(spark, sf):
    """Clients seen less than their interval before the last morning."""
    seen = read(spark, sf, "clicks").groupBy(_source()).agg(F.max("ts").alias("last_scan_at"))
    known = read(spark, sf, "clients").select(_source()).distinct().withColumn("min_interval_minutes", (30 + F.col("source") % 600).cast("int"))
    return scans.throttled(seen, known, _at(_NOW)).select("source", "last_scan_at", "min_interval_minutes", "until")


@query(f"with {_SEEN} select source as series, last_scan_at as last from c left join s using (source) where last_scan_at is null or timestamp '{_NOW}' >= last_scan_at + interval 12 hour")
def stale_keys(spark, sf):
    """Clients never seen, or not within twelve hours."""
    seen = read(spark, sf, "clicks").select(_source().alias("series"), F.col("ts").alias("fetched_at"))
    known = read(spark, sf, "clients").select(_source().alias("series")).distinct()
    return scans.stale(seen, known, _at(_NOW))


_SCANNED = f"""b as (select coalesce(client_id, -1) as source, max(sold_at) as last_scan_at, cast(count(*) as integer) as recent_yield, cast(coalesce(client_id, -1) % 3 + 1 as integer) as failures from sales where sold_at < timestamp '{_CUT}' group by 1, coalesce(client_id, -1) % 3),
r as (select coalesce(client_id, -1) as source, coalesce(client_id, -1) % 5 <> 0 as ok, cast(count(*) filter (where status = 'F') as integer) as yielded, max(sold_at) as seen from sales where sold_at >= timestamp '{_CUT}' group by 1, 2)"""


def _scanned(spark, sf):
    sales = read(spark, sf, "sales")
    before = sales.where(F.col("sold_at") < _at(_CUT)).groupBy(_source()).agg(F.max("sold_at").alias("last_scan_at"), F.count("*").cast("int").alias("recent_yield"))
    before = before.withColumn("failures", (F.col("source") % 3 + 1).cast("int"))
    after = sales.where(F.col("sold_at") >= _at(_CUT)).groupBy(_source()).agg(F.count_if(F.col("status") == "F").cast("int").alias("yielded"), F.max("sold_at").alias("at"))
    return before, after.withColumn("ok", F.col("source") % 5 != 0)


@query(f"with {_SCANNED} select source, case when ok then seen else last_scan_at end as last_scan_at, case when ok and yielded > 0 then yielded else coalesce(recent_yield, 0) end as recent_yield, case when ok then 0 when ok is null then coalesce(failures, 0) else coalesce(failures, 0) + 1 end as failures, coalesce(ok and coalesce(yielded, 0) = 0 and coalesce(recent_yield, 0) > 0, false) as went_silent from b full join r using (source)")
def scan_states(spark, sf):
    """State of every source after a scan in which some fail, some yield nothing and some are not scanned: each apart from the others."""
    return scans.after_scan(*_scanned(spark, sf))


@query(f"with {_SCANNED}, c as (select distinct coalesce(client_id, -1) as source, true as enabled from clients) select source, enabled, last_scan_at, coalesce(recent_yield, 0) as recent_yield, coalesce(failures, 0) as failures from c left join b using (source)")
def source_health(spark, sf):
    known = read(spark, sf, "clients").select(_source()).distinct().withColumn("enabled", F.lit(True))
    return scans.health(known, _scanned(spark, sf)[0])


@query("with d as (select doc_id, source, text as title, cast(null as varchar) as summary, lang as date_text from documents) select doc_id, coalesce(contains(lower(concat_ws(' ', title, summary, date_text)), 'tion the'), false) or contains(lower(concat_ws(' ', title, summary, date_text)), ' de') as excluded from d")
def excluded_items(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.col("text").alias("title"), F.lit(None).cast("string").alias("summary"), F.col("lang").alias("date_text"))
    return d.select("doc_id", scans.excluded(d, ["tion THE", " de"]).alias("excluded"))


@query("select sale_id, coalesce(client_id, -1) as source, row_number() over (partition by coalesce(client_id, -1) order by sale_id, sold_at, total, status) <= 3 as read_detail from sales")
def detail_budget(spark, sf):
    """The first three sales of each client get their details read."""
    items = read(spark, sf, "sales").select("sale_id", _source(), F.struct("sale_id", "sold_at", "total", "status").alias("position"))
    return scans.detail_budget(items, 3).select("sale_id", "source", "read_detail")


@query("with b as (select distinct coalesce(client_id, -1) as client from sales where sold_at < timestamp '2024-02-01') select distinct cast(sale_id as varchar) as key from sales where coalesce(client_id, -1) not in (select client from b)")
def seeded_keys(spark, sf):
    """What is sold to clients that the ledger has never seen is stamped as known, and is no news."""
    sales = read(spark, sf, "sales").select("sale_id", "sold_at", _source("client_id").alias("client"))
    now = F.lit(_NOW).cast("timestamp")
    before = sales.where(F.col("sold_at") < _at("2024-02-01 00:00:00")).select(F.lit("sales").alias("domain"), F.col("sale_id").cast("string").alias("key"), now.alias("stamped_at")).distinct()
    return state.Ledger(before, "sales").seed(sales, F.col("sale_id"), ["client"], now).select("key")


@query("with s as (select sale_id, coalesce(client_id, -1) as source, cast(sold_at as date) as day from sales), n as (select source, max(day) - 30 as since from s group by 1) select sale_id, source, day from s join n using (source) where day >= since")
def trailing_sales(spark, sf):
    """Each client's sales within thirty days of its newest."""
    sales = read(spark, sf, "sales").select("sale_id", _source(), F.col("sold_at").cast("date").alias("day"))
    return readers.trailing_days(sales, "source", "day", 30)


@query("select coalesce(priority, 'none') as kind, max(sold_at) as last_success from sales where status = 'F' group by 1")
def last_success(spark, sf):
    """The newest finished sale of each priority, as the newest good run of each kind."""
    ok = F.when(F.col("status") == "F", "ok").otherwise("failed")
    return scans.last_success(read(spark, sf, "sales").select(F.coalesce("priority", F.lit("none")).alias("kind"), F.col("sold_at").alias("started_at"), ok.alias("status")))


@query("select sale_id, coalesce(client_id, -1) as ticker from sales where (status is distinct from 'O' or sold_at is null) and not coalesce(total < 100, false) and coalesce(client_id, -1) in (select coalesce(client_id, -1) from clients where balance > 0)")
def pending_sales(spark, sf):
    """What is neither told (open sales are) nor suppressed, of clients with money."""
    told = F.when(F.col("status") == "O", F.col("sold_at"))
    news = read(spark, sf, "sales").select("sale_id", _source().alias("ticker"), told.alias("notified_at"), F.coalesce(F.col("total") < 100, F.lit(False)).alias("suppressed"))
    wanted = read(spark, sf, "clients").where("balance > 0").select(_source().alias("ticker"))
    return reports.pending_news(news, wanted).select("sale_id", "ticker")


@query("with d as (select distinct cast(sold_at as date) as day from sales where sold_at is not null) select day, day + cast(case isodow(day) when 5 then 3 when 6 then 2 else 1 end as integer) as next_day from d")
def next_sessions(spark, sf):
    """The weekday after each day of sale."""
    days = read(spark, sf, "sales").where("sold_at is not null").select(F.col("sold_at").cast("date").alias("day")).distinct()
    return days.select("day", scans.next_session(F.col("day")).alias("next_day"))


_SPELT = "brand || case item_id % 4 when 0 then '.HK' when 1 then '.B' when 2 then '.T ' else '' end"


@query(f"with t as (select item_id, lower(trim({_SPELT})) as low from items) select item_id, case when not regexp_matches(low, '[.](hk|ss|sz|t|l)$') then replace(low, '.', '-') || '.us' end as symbol from t")
def fallback_symbols(spark, sf):
    """Items' brands with the endings of markets, as the fallback source spells them: none for foreign ones."""
    return read(spark, sf, "items").select("item_id", readers.fallback_symbol(F.expr(_SPELT)).alias("symbol"))
