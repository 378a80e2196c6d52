"""The driver's tables in the shapes of the operators, as frames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import BUCKETS, hour_bucket, quarter_index
from ..session import read


def r6(x: Column) -> Column:
    """Six decimals: what does not depend on the order of additions."""
    return x.cast("decimal(38,6)").cast("double")


def expenses(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("member"), F.when(F.col("event_type") == "error", "Uncategorized").otherwise(F.col("event_type")).alias("category"),
        F.concat(F.lit("k"), (F.col("user_id") % 7).cast("string")).alias("keyword"), F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("description"), F.col("value").alias("amount"), "ts",
    )


def bars(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("ticker"), F.col("o_orderdate").cast("date").alias("day")).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.max_by("o_totalprice", "o_orderkey").alias("close"), F.count("*").cast("double").alias("volume"))


def quarters(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return o.groupBy(quarter_index(F.col("o_orderdate")).alias("q_index")).agg(n("F").alias("land_ready"), n("O").alias("being_built"), n("P").alias("built_not_sold"), F.count("*").alias("total"))


def fares(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    run = F.col("ts").cast("date")
    return e.select(
        F.col("event_id").alias("id"), run.alias("run_date"), F.col("event_type").alias("airline"), hour_bucket(F.hour("ts")).alias("dep_bucket"),
        F.element_at(F.array(*[F.lit(b) for b in BUCKETS]), (F.col("user_id") % 8 + 1).cast("int")).alias("ret_bucket"), F.col("value").alias("price"),
        F.date_add(run, (F.col("user_id") % 5).cast("int")).alias("depart_date"), F.date_format("ts", "HH:mm").alias("depart_time"), (F.col("user_id") % 3).cast("int").alias("ret_stops"),
    )


def news(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("title"), "source", F.col("lang").alias("category"), F.concat(F.lit("https://www."), F.col("source"), F.lit(".example.com/"), F.col("doc_id").cast("string"), F.lit("/?utm_source=x&id="), F.col("doc_id").cast("string"), F.lit("#top")).alias("url"))


def trades(spark: SparkSession, sf: str, sold: Column | None = None) -> DataFrame:
    t = read(spark, sf, "lineitem")
    sold = F.col("l_returnflag") == "R" if sold is None else sold
    return t.select(
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")).alias("id"), F.col("l_suppkey").cast("string").alias("ticker"), F.col("l_shipdate").cast("date").alias("trade_date"),
        F.when(sold, "sell").otherwise("buy").alias("side"), F.col("l_quantity").cast("double").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_tax").alias("fee"),
    )


CONDITIONS = "array<struct<kind:string,params:map<string,string>,text:string>>"


def coupons(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    k = F.col("o_orderkey")
    condition = lambda kind, **p: F.struct(F.lit(kind).alias("kind"), F.create_map(*[x for a, b in p.items() for x in (F.lit(a.rstrip("_")), F.lit(b))]).alias("params"), F.lit(None).cast("string").alias("text"))
    kinds = [condition("time_window", days='["0","1","2","3","4"]', from_="11:30", to="14:30"), condition("channel", allow='["online"]'), condition("location", branches='["Central","Mong Kok"]'), condition("min_spend", amount="100")]
    chosen = F.when(k % 4 == 0, F.array(kinds[0])).when(k % 4 == 1, F.array(kinds[1])).when(k % 4 == 2, F.array(kinds[2])).otherwise(F.array(kinds[3]))
    return o.select(
        k.alias("id"), F.col("o_custkey").cast("string").alias("account_id"), F.col("o_orderpriority").alias("merchant"), F.concat(F.lit("offer "), (k % 97).cast("string")).alias("title"), F.col("o_orderdate").cast("date").alias("expires_on"),
        F.when(F.col("o_orderstatus") == "F", "used").when(F.col("o_orderstatus") == "O", "active").otherwise("needs_review").alias("status"),
        F.when(k % 5 != 0, k % 700).alias("media_id"), F.lit(3).alias("uses_total"), chosen.cast(CONDITIONS).alias("conditions"),
    )


def media(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer")
    return c.select((F.col("c_custkey") % 1000).alias("media_id"), F.col("c_custkey").cast("string").alias("account_id")).distinct()


def macro(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    per = e.groupBy(F.col("event_type").alias("series"), F.col("ts").cast("date").alias("as_of")).agg(F.sum(F.col("value").cast("decimal(38,2)")).cast("double").alias("value"))
    return per.withColumn("notified_at", F.when(F.day("as_of") % 7 == 0, F.col("as_of").cast("timestamp_ntz")))


def messages(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part")
    item = F.concat(F.col("p_name"), F.lit(" $"), F.format_string("%.2f", F.col("p_retailprice")))
    return p.groupBy((F.col("p_partkey") % 500).alias("message_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", item.alias("t")))), lambda s: s["t"]), "; ").alias("text"), F.first(F.lit("Alice")).alias("member"), F.min(F.lit("2026-07-19 11:00:00")).cast("timestamp_ntz").alias("ts"))


SQL = {
    "v_expenses": "select event_id as id, cast(user_id as varchar) as member, case when event_type = 'error' then 'Uncategorized' else event_type end as category, 'k' || cast(user_id % 7 as varchar) as keyword, event_type || ' ' || cast(event_id as varchar) as description, cast(value as decimal(38,2)) as amount, ts from events",
    "v_bars": "select o_orderpriority as ticker, cast(o_orderdate as date) as day, arg_min(o_totalprice, o_orderkey) as open, max(o_totalprice) as high, min(o_totalprice) as low, arg_max(o_totalprice, o_orderkey) as close, cast(count(*) as double) as volume from orders group by 1, 2",
    "v_quarters": "select cast(year(o_orderdate) * 4 + quarter(o_orderdate) as integer) as q_index, count(*) filter (where o_orderstatus = 'F') as land_ready, count(*) filter (where o_orderstatus = 'O') as being_built, count(*) filter (where o_orderstatus = 'P') as built_not_sold, count(*) as total from orders group by 1",
    "v_fares": "select event_id as id, cast(ts as date) as run_date, event_type as airline, printf('%02d-%02d', (hour(ts) // 3) * 3, (hour(ts) // 3) * 3 + 3) as dep_bucket, printf('%02d-%02d', (user_id % 8) * 3, (user_id % 8) * 3 + 3) as ret_bucket, value as price, cast(ts as date) + cast(user_id % 5 as integer) as depart_date, strftime(ts, '%H:%M') as depart_time, cast(user_id % 3 as integer) as ret_stops from events",
    "v_news": "select doc_id as id, split_part(text, chr(10), 1) as title, source, lang as category, 'https://www.' || source || '.example.com/' || cast(doc_id as varchar) || '/?utm_source=x&id=' || cast(doc_id as varchar) || '#top' as url from documents",
    "v_trades": "select (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey as id, cast(l_suppkey as varchar) as ticker, cast(l_shipdate as date) as trade_date, case when l_returnflag = 'R' then 'sell' else 'buy' end as side, cast(l_quantity as double) as quantity, l_extendedprice / l_quantity as price, l_tax as fee from lineitem",
    "v_coupons": "select o_orderkey as id, cast(o_custkey as varchar) as account_id, o_orderpriority as merchant, 'offer ' || cast(o_orderkey % 97 as varchar) as title, cast(o_orderdate as date) as expires_on, case o_orderstatus when 'F' then 'used' when 'O' then 'active' else 'needs_review' end as status, case when o_orderkey % 5 <> 0 then o_orderkey % 700 end as media_id from orders",
    "v_media": "select distinct c_custkey % 1000 as media_id, cast(c_custkey as varchar) as account_id from customer",
    "v_macro": "select event_type as series, cast(ts as date) as as_of, cast(sum(cast(value as decimal(38,2))) as double) as value, case when day(cast(ts as date)) % 7 = 0 then cast(cast(ts as date) as timestamp) end as notified_at from events group by event_type, cast(ts as date)",
}


def with_views(sql: str, *names: str) -> str:
    return "with " + ", ".join(f"{n} as ({SQL[n]})" for n in names) + " " + sql
