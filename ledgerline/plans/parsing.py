"""Parsers and scalar functions over made-up text whose meaning SQL knows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, dates, numbers, text
from ..operators import coupons, fares, messages, registers, scans
from ..session import read
from ..sources import readers
from . import adapters as a
from .registry import query

_MONTH = "(['January','February','March','April','May','June','July','August','September','October','November','December'])"
_CLOCK = "case when h % 12 = 0 then 12 else h % 12 end || ':' || printf('%02d', m) || ' ' || case when h < 12 then 'AM' else 'PM' end"


_SAID = [
    # one leg, spoken; two legs, spoken; one leg in the short form; two of them
    "From {price} Hong Kong dollars round trip total. {stops} with Cathay Pacific and Qantas. Leaves Hong Kong International Airport at {clock} on Friday, December 18 and arrives at Dubai International Airport at 6:05 AM on Saturday, December 19.",
    "From {price} euros round trip total. {stops} with Emirates. Leaves Hong Kong Airport at {clock} on Friday, December 18 and arrives at Dubai International Airport at 6:05 AM on Saturday, December 19. Leaves Dubai International Airport at 9:15 AM on Friday, January 1 and arrives at Hong Kong International Airport at 8:45 PM on Friday, January 1.",
    "{clock} HKG to DXB, 7h 30m, Emirates EK 381. Price: ${price}",
    "{clock} HKG to DXB, 7h 30m, 1 stop, Cathay Pacific. 5:00 PM DXB to HKG, 8h, nonstop, Emirates. Price: HKD {price}",
]


def _labels(spark, sf):
    """A fare label for each order, of four shapes by turns: its numbers are the label's."""
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 24).cast("int").alias("h"), (F.col("o_orderkey") % 60).cast("int").alias("m"), (F.col("o_orderkey") % 3).cast("int").alias("stops"), (F.col("o_orderkey") % 9000 + 1000).alias("price"))
    half = F.when(F.col("h") < 12, "AM").otherwise("PM")
    clock = F.concat(F.when(F.col("h") % 12 == 0, 12).otherwise(F.col("h") % 12).cast("string"), F.lit(":"), F.format_string("%02d", F.col("m")), F.lit("\u202f"), half)
    stops = F.when(F.col("stops") == 0, "Nonstop flight").otherwise(F.concat(F.col("stops").cast("string"), F.lit(" stop flight")))
    price = F.format_string("%,d", F.col("price"))
    label = F.element_at(F.array(*[F.lit(x) for x in _SAID]), (F.col("id") % 4 + 1).cast("int"))
    for mark, value in (("{price}", price), ("{clock}", clock), ("{stops}", stops)):
        label = F.replace(label, F.lit(mark), value)
    return o.select("id", label.alias("label"))


@query("""
with o as (select o_orderkey as id, o_orderkey % 4 as shape, o_orderkey % 24 as h, o_orderkey % 60 as m from orders)
select id, 'HKG' as origin, 'DXB' as dest, printf('%02d:%02d', h, m) as depart_time, case when shape < 2 then '06:05' end as arrive_time,
       case when shape < 2 then 1 else 0 end as day_shift, case when shape < 2 then cast(365 - (h * 60 + m) + 1440 as integer) else 450 end as duration_min,
       cast(case shape when 2 then 0 when 3 then 1 else id % 3 end as integer) as stops, case when shape in (0, 3) then 'Cathay Pacific' else 'Emirates' end as airline,
       case when shape = 2 then 'EK381' end as flight_no, cast(id % 9000 + 1000 as double) as price, case shape when 1 then 'EUR' when 2 then null else 'HKD' end as currency,
       shape <> 2 as round_trip, case when shape in (1, 3) then 2 else 1 end as n_legs, case when shape in (1, 3) then 'HKG' else 'DXB' end as last_dest,
       case shape when 1 then '09:15' when 3 then '17:00' else printf('%02d:%02d', h, m) end as last_depart,
       case shape when 1 then 690 when 3 then 480 when 2 then 450 else cast(365 - (h * 60 + m) + 1440 as integer) end as last_duration,
       case when shape = 0 then 'Cathay Pacific' else 'Emirates' end as last_airline
from o
""")
def parse_labels(spark, sf):
    parsed = _labels(spark, sf).withColumn("p", fares.parse_label(F.col("label")))
    last = F.element_at("p.legs", -1)
    more = [F.size("p.legs").alias("n_legs"), last["dest"].alias("last_dest"), last["depart_time"].alias("last_depart"), last["duration_min"].alias("last_duration"), last["airline"].alias("last_airline")]
    return parsed.select("id", "p.*", *more).drop("legs")


@query("select o_orderkey as id, o_orderkey % 4 in (1, 3) as back from orders where o_orderkey % 4 in (1, 3) union all select o_orderkey, false from orders")
def fare_directions(spark, sf):
    """Options with a leg back, and all with a leg there."""
    options = _labels(spark, sf).withColumn("option", fares.parse_label(F.col("label")))
    return fares.directions(options, F.lit("HKG"), F.lit("DXB")).select("id", "back")


@query("select o_orderkey as id, case when o_orderkey % 20 between 10 and 20 then cast(o_orderkey % 100 as varchar) || 'th' end as teen, printf('%02d:%02d', (cast(o_orderkey % 24 as integer) * 60 + cast(o_orderkey % 60 as integer) + 95) // 60 % 24, (cast(o_orderkey % 60 as integer) + 35) % 60) as later, cast(last_day(make_date(cast((8100 + o_orderkey % 8 - 1) // 4 as integer), cast((8100 + o_orderkey % 8 - 1) % 4 * 3 + 3 as integer), 1)) as date) as quarter_end from orders")
def clock_arithmetic(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    clock = F.format_string("%02d:%02d", F.col("id") % 24, F.col("id") % 60)
    teen = F.when((F.col("id") % 20).between(10, 20), F.concat((F.col("id") % 100).cast("string"), F.lit("th")))
    return o.select("id", teen.alias("teen"), dates.add_minutes(clock, F.lit(95)).alias("later"), dates.quarter_end(F.lit(8100) + (F.col("id") % 8).cast("int")).alias("quarter_end"))


@query("select o_orderkey as id, cast(o_orderkey % 130 as varchar) || case when (o_orderkey % 130) % 100 between 10 and 20 then 'th' when o_orderkey % 10 = 1 then 'st' when o_orderkey % 10 = 2 then 'nd' when o_orderkey % 10 = 3 then 'rd' else 'th' end as place from orders")
def ordinals(spark, sf):
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), numbers.ordinal((F.col("o_orderkey") % 130).cast("double")).alias("place"))


@query("select event_id, cast(json_extract_string(props, '$.k') as integer) as k, try_cast(nullif(case when event_id % 5 = 0 then '.' else json_extract_string(props, '$.k') end, '.') as double) as figure from events")
def vendor_figures(spark, sf):
    k = readers.first_key(F.col("props"), "missing", "k")
    return read(spark, sf, "events").select("event_id", k.cast("int").alias("k"), numbers.vendor_number(F.when(F.col("event_id") % 5 == 0, " . ").otherwise(k)).alias("figure"))


@query("select event_type as series, max(cast(ts as date)) as as_of, arg_max(value, (ts, event_id)) as value from events group by 1")
def newest_reading(spark, sf):
    e = read(spark, sf, "events")
    last = e.groupBy(F.col("event_type").alias("series"), F.col("ts").cast("date").alias("as_of")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    payloads = last.groupBy("series").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("as_of").cast("string").alias("date"), F.col("value").cast("string").alias("value"))).alias("data"))).alias("payload"))
    return readers.newest_observation(payloads)


@query("select o_orderkey as id, case when o_orderkey % 4 = 0 then null else timestamp '2026-08-21 14:47:00' + (o_orderkey % 1000) * interval 1 minute end as at from orders")
def vendor_times(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.lit("2026-08-21 14:47:00").cast("timestamp") + F.make_interval(mins=(F.col("o_orderkey") % 1000).cast("int"))).alias("t"))
    said = F.when(F.col("id") % 4 == 0, "yesterday").when(F.col("id") % 4 == 1, F.date_format("t", "yyyyMMdd'T'HHmmss")).when(F.col("id") % 4 == 2, F.date_format("t", "yyyyMMdd'T'HHmm")).otherwise(F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return o.select("id", dates.vendor_time(said).cast("timestamp_ntz").alias("at"))


@query("select event_id, ts + interval 8 hour as local, ts as utc from events")
def local_times(spark, sf):
    e = read(spark, sf, "events").select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias("v"))
    return e.select("event_id", dates.parse_local(F.col("v"), "Asia/Hong_Kong").alias("p")).select("event_id", "p.local", "p.utc")


@query("select s_suppkey as id, case s_suppkey % 4 when 0 then 'HK' when 1 then 'JP' when 2 then 'UK' else 'US' end as market from supplier")
def markets(spark, sf):
    ending = F.element_at(F.array(*[F.lit(x) for x in (".HK", ".t", ".L", "")]), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), scans.market_of(F.concat(F.lit("X"), ending))["market"].alias("market"))


@query("select event_id, weekday not in (5, 6) and s between 41400 and 52200 as lunch, weekday = 5 and (s >= 79200 or s <= 7200) as night from (select event_id, (dayofweek(ts) + 6) % 7 as weekday, hour(ts) * 3600 + minute(ts) * 60 + second(ts) as s from events)")
def time_windows(spark, sf):
    return read(spark, sf, "events").select("event_id", dates.in_window(F.col("ts"), [0, 1, 2, 3, 4], 690, 870).alias("lunch"), dates.in_window(F.col("ts"), [5], 1320, 120).alias("night"))


@query("with q as (select cast(year(o_orderdate) * 4 + quarter(o_orderdate) as integer) as q_index, count(*) as n from orders group by 1) select q_index, n * 1000 as land_ready, case when q_index % 7 = 0 then 'rejected' else 'read' end as outcome from q")
def quarter_rows(spark, sf):
    q = a.quarters(spark, sf)
    number = F.format_string("%,d", F.col("total") * 1000)
    raw = q.select(F.concat(F.lit(" "), dates.quarter_label(F.col("q_index"))).alias("quarter"), number.alias("land_ready"), F.when(F.col("q_index") % 7 == 0, "n/a").otherwise("1").alias("being_built"), F.lit("2").alias("built_not_sold"), F.lit("3").alias("total"))
    good, bad = readers.split_quarters(raw)
    cols = ("q_index", F.col("land_ready").cast("long").alias("land_ready"))
    return good.select(*cols, F.lit("read").alias("outcome")).unionByName(bad.select(*cols, F.lit("rejected").alias("outcome")))


@query("select doc_id, md5(text) as unchanged, regexp_replace(text, ' - ' || source || '$', '') = text as same from documents")
def outlet_suffix(spark, sf):
    d = read(spark, sf, "documents")
    return d.select("doc_id", F.md5(F.col("text")).alias("unchanged"), (text.without_outlet(F.concat(F.col("text"), F.lit(" - "), F.col("source")), F.col("source")) == F.rtrim("text")).alias("same"))


@query("select c_custkey as id, 'Ann' as member from customer where c_custkey % 3 = 0 union all select c_custkey, 'user' || cast(c_custkey as varchar) from customer where c_custkey % 3 <> 0")
def member_alias(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.lit(" aNNie")).otherwise(F.concat(F.lit("user"), F.col("c_custkey").cast("string"))).alias("member"))
    return messages.resolve_member(c, spark.sql("select 'Annie' as alias, 'Ann' as member"))


_NEWEST = "with c as (select o_orderkey as id, lower(o_orderpriority) || '|offer ' || cast(o_orderkey % 97 as varchar) || '|' || cast(cast(o_orderdate as date) as varchar) as k from orders) select id, min(id) over (partition by k) as duplicate_of from c"


@query(_NEWEST)
def find_duplicates(spark, sf):
    c = a.coupons(spark, sf).select("id", text.dedupe_key(F.col("merchant"), F.col("title"), F.col("expires_on").cast("string")).alias("dedupe_key"))
    return registers.find_duplicate(c.withColumn("created_at", F.col("id")), c).select("id", "duplicate_of")


@query("select l_orderkey as id, count(*) as n from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'P') group by 1")
def semi_join(spark, sf):
    pending = read(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"))
    return read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id")).join(pending, "id", "left_semi").groupBy("id").agg(F.count("*").alias("n"))


@query("select n_name as ticker, n_name as symbol, cast(null as varchar) as peer_of from nation union all select a.n_name, b.n_name, b.n_name from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_name <> b.n_name")
def feed_requests(spark, sf):
    n = read(spark, sf, "nation").select(F.col("n_name").alias("ticker"), "n_regionkey")
    peers = n.groupBy("n_regionkey").agg(F.collect_list("ticker").alias("all"))
    return readers.feed_requests(n.join(peers, "n_regionkey").select("ticker", F.array_remove("all", F.col("ticker")).alias("competitors")))


@query("select p_partkey as id, case when p_partkey % 3 = 0 then 'C' when p_partkey % 3 = 1 then 'A' else 'B' end as subject, cast(p_partkey % 10 as double) / 10 as sentiment from part")
def ranked_subjects(spark, sf):
    p = read(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    best = F.element_at(F.array(*[F.lit(x) for x in "CAB"]), (F.col("id") % 3 + 1).cast("int"))
    entry = lambda t: F.struct(F.lit(t).alias("ticker"), F.when(best == t, "0.9").otherwise("0.2").alias("relevance_score"), ((F.col("id") % 10) / 10).cast("string").alias("ticker_sentiment_score"), F.lit("x").alias("ticker_sentiment_label"))
    payload = F.to_json(F.struct(F.lit("T").alias("title"), F.col("id").cast("string").alias("url"), F.array(*[entry(t) for t in "ABC"]).alias("ticker_sentiment")))
    raw = p.withColumn("payload", payload).select(F.explode(F.array(*[F.lit(t) for t in "ABC"])).alias("ticker"), F.lit(None).cast("string").alias("peer_of"), "payload")
    return readers.scored_news(raw).where("is_subject").select(F.col("url").cast("long").alias("id"), F.col("ticker").alias("subject"), F.col("sentiment_score").alias("sentiment"))


@query("select p_partkey as id, 'acme widgets inc' as first_alias from part where p_partkey % 2 = 0 union all select p_partkey, 'abc' from part where p_partkey % 2 = 1")
def company_aliases(spark, sf):
    p = read(spark, sf, "part")
    names = classify.aliases(F.when(F.col("p_partkey") % 2 == 0, "0700.HK").otherwise("ABC"), F.lit("Acme Widgets, Inc."))
    return p.select(F.col("p_partkey").alias("id"), F.get(names, F.lit(0)).alias("first_alias"))


@query(a.with_views("select id, expires_on from v_coupons where status = 'used' and contains(lower(merchant), 'low') and expires_on < date '1998-05-06' - 365", "v_coupons"))
def purge_selection(spark, sf):
    return registers.purge_selection(a.coupons(spark, sf), F.lit("1998-05-06").cast("date"), status=["used"], merchant="LOW", older_than_days=365).select("id", "expires_on")


@query("select c_custkey as account_id, 'm' || cast(c_custkey as varchar) as media_id, true as reused from customer where c_acctbal > 0 union all select c_custkey, sha1(cast(c_custkey as varchar) || '|h'), false from customer where c_acctbal <= 0")
def media_register(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("account_id"), F.lit("h").alias("sha256"), "c_acctbal")
    known = c.where("c_acctbal > 0").withColumn("media_id", F.concat(F.lit("m"), F.col("account_id").cast("string")))
    return registers.register_media(known, c).select("account_id", "media_id", "reused")


@query(a.with_views(", r as (select *, cast(q_index as integer) as i from v_quarters) select q_index, total from r where q_index >= 7990", "v_quarters"))
def quarter_append(spark, sf):
    q = a.quarters(spark, sf).select(dates.quarter_label(F.col("q_index")).alias("quarter"), "q_index", "land_ready", "being_built", "built_not_sold", F.lit(None).cast("long").alias("total"))
    good, _ = registers.add_quarter(q.where("q_index < 7990"), q)
    return good.select("q_index", "total")


@query("select o_orderkey as id, o_custkey as account_id from orders where o_custkey <> 7")
def cascade_delete(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("account_id"))
    return coupons.cascade(7, o)[0]
