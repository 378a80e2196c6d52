"""Quarters, visual rows, fares."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import asof, fares, rollup
from ..session import read
from . import adapters as a
from .registry import query

Q, P = "v_quarters", "v_fares"
_LABEL = "cast((q_index - 1) // 4 as varchar) || '/' || (['Mar','Jun','Sep','Dec'])[cast((q_index - 1) % 4 + 1 as integer)]"


@query(a.with_views(f", j as (select q.*, p.total as before from v_quarters q left join v_quarters p on p.q_index + 1 = q.q_index) select q_index, land_ready, being_built, built_not_sold, total, before, {_LABEL} as quarter, total - before as delta, cast(cast(case when before <> 0 then 100.0 * (total - before) / before end as decimal(38,6)) as double) as pct, case when before is null then 'unavailable' else 'previous quarter' end as basis, case when total > before then 'up' when total < before then 'down' when total = before then 'flat' else 'none' end as direction from j", Q))
def qoq_table(spark, sf):
    return asof.quarter_on_quarter(a.quarters(spark, sf)).withColumn("pct", a.r6(F.col("pct")))


@query(a.with_views(f", j as (select q.*, p.total as before from v_quarters q left join v_quarters p on p.q_index + 1 = q.q_index) select q_index, {_LABEL} as quarter, total, total - before as delta from j where q_index <= 8000 order by q_index desc limit 8", Q))
def quarter_window(spark, sf):
    return asof.quarter_table(a.quarters(spark, sf), 8, 8000).select("q_index", "quarter", "total", "delta")


@query(a.with_views(", e as (select q_index, last_day(make_date(cast((q_index) // 4 as integer), cast((q_index % 4) * 3 + 3 as integer), 1)) as next_end from v_quarters) select q_index, date '1999-06-01' > next_end + 100 as overdue from e", Q))
def overdue_quarter(spark, sf):
    return a.quarters(spark, sf).select("q_index", dates.overdue(F.col("q_index"), F.lit("1999-06-01").cast("date")).alias("overdue"))


@query("with w as (select page_id % 20 as page, cast(page_id as double) * 3 % 41 as centre, page_id as x0, cast(page_id as varchar) as text from pages), s as (select *, case when centre - lag(centre) over (partition by page order by centre, x0) > 8 then 1 else 0 end as g from w), n as (select *, sum(g) over (partition by page order by centre, x0 rows unbounded preceding) as row from s) select page, cast(row as bigint) as row, string_agg(text, ' ' order by x0, text) as line, count(*) as n from n group by page, row")
def gaps_islands(spark, sf):
    p = read(spark, sf, "pages").select((F.col("page_id") % 20).alias("page"), (F.col("page_id").cast("double") * 3 % 41).alias("centre"), F.col("page_id").alias("x0"), F.col("page_id").cast("string").alias("text"))
    return asof.islands(p, ["page"], "centre").select("page", F.col("row").cast("long").alias("row"), "line", "n")


@query(a.with_views(", r as (select *, row_number() over (partition by airline, dep_bucket, ret_bucket order by price, depart_date, id) as k from v_fares) select airline, dep_bucket, ret_bucket, price, depart_date, id from r where k = 1", P))
def cheapest_grouping(spark, sf):
    f = a.fares(spark, sf).select("airline", "dep_bucket", "ret_bucket", "price", "depart_date", "id")
    return fares.cheapest(f, ["airline", "dep_bucket", "ret_bucket"], ["depart_date", "id"])


@query(a.with_views("select airline, dep_bucket, " + ", ".join(f"min(price) filter (where ret_bucket = '{b}') as \"{b}\"" for b in dates.BUCKETS) + " from v_fares group by 1, 2", P))
def fare_heatmap(spark, sf):
    return fares.heatmap(a.fares(spark, sf))


@query(a.with_views("select airline, dep_bucket, run_date, min(price) as price from v_fares group by 1, 2, 3", P))
def fare_trend(spark, sf):
    return fares.trend(a.fares(spark, sf), ["airline", "dep_bucket"])


@query(a.with_views(", t as (select airline, dep_bucket, run_date, min(price) as price from v_fares group by 1, 2, 3), l as (select airline, dep_bucket, min(price) as lowest from t group by 1, 2), r as (select *, row_number() over (order by lowest, airline, dep_bucket) as rank from l) select airline, dep_bucket, run_date, price, lowest, cast(rank as integer) as rank from t join r using (airline, dep_bucket) where rank <= 5", P))
def trend_lines(spark, sf):
    return fares.trend_lines(fares.trend(a.fares(spark, sf), ["airline", "dep_bucket"]), ["airline", "dep_bucket"])


_CELL = ", t as (select airline, dep_bucket, run_date, min(price) as price from v_fares group by 1, 2, 3)"
_PCT = "cast(cast(100.0 * (current - prior) / nullif(prior, 0) as decimal(38,6)) as double) as pct, cast(cast(current - prior as decimal(38,6)) as double) as delta"


@query(a.with_views(_CELL + f", n as (select airline, dep_bucket, arg_max(price, run_date) as current, max(run_date) as current_date, arg_max(price, run_date) filter (where run_date <= date '2024-01-13') as prior, max(run_date) filter (where run_date <= date '2024-01-13') as prior_date from t where run_date <= date '2024-01-20' group by 1, 2) select *, {_PCT} from n", P))
def wow_exact(spark, sf):
    m = asof.movement(fares.trend(a.fares(spark, sf), ["airline", "dep_bucket"]), ["airline", "dep_bucket"], "run_date", "price", "2024-01-20")
    return m.withColumns({"pct": a.r6(F.col("pct")), "delta": a.r6(F.col("delta"))})


@query(a.with_views(_CELL + f", c as (select airline, dep_bucket, price as current from t where run_date = date '2024-01-20'), p as (select airline, dep_bucket, run_date as prior_date, price as prior, row_number() over (partition by airline, dep_bucket order by abs(run_date - date '2024-01-13'), run_date) as k from t where abs(run_date - date '2024-01-13') <= 3) select airline, dep_bucket, current, prior, prior_date, {_PCT} from c left join (select * from p where k = 1) using (airline, dep_bucket)", P).replace("select airline, dep_bucket, current, prior, prior_date, ", "select c.airline, c.dep_bucket, current, prior, prior_date, "))
def wow_tolerance(spark, sf):
    m = asof.nearest(fares.trend(a.fares(spark, sf), ["airline", "dep_bucket"]), ["airline", "dep_bucket"], "run_date", "price", "2024-01-20")
    return m.withColumns({"pct": a.r6(F.col("pct")), "delta": a.r6(F.col("delta"))})


@query(a.with_views(_CELL + ", n as (select airline, dep_bucket, arg_max(price, run_date) as current, arg_max(price, run_date) filter (where run_date <= date '2024-01-13') as prior from t where run_date <= date '2024-01-20' group by 1, 2) select airline, dep_bucket, cast(cast(current - prior as decimal(38,6)) as double) as delta from n where current < prior order by current - prior, airline, dep_bucket limit 5", P))
def movers(spark, sf):
    m = asof.movement(fares.trend(a.fares(spark, sf), ["airline", "dep_bucket"]), ["airline", "dep_bucket"], "run_date", "price", "2024-01-20")
    return m.where("delta < 0").orderBy("delta", "airline", "dep_bucket").limit(5).select("airline", "dep_bucket", a.r6(F.col("delta")).alias("delta"))


@query("with s as (select c_nationkey as scope, date '2026-11-01' + cast(min(c_custkey) % 5 as integer) as a from customer group by 1), d as (select scope, a, unnest(generate_series(0, 3)) as i from s), p as (select scope, a, i, unnest(generate_series(0, 9)) as j from d) select scope, cast(a + cast(i as integer) as date) as depart_date, cast(a + cast(j as integer) as date) as return_date, cast(j - i as integer) as nights from p where j - i between 3 and 6")
def date_pairs(spark, sf):
    s = read(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("scope")).agg(F.date_add(F.lit("2026-11-01").cast("date"), (F.min("c_custkey") % 5).cast("int")).alias("a"))
    scopes = s.select("scope", F.col("a").alias("depart_from"), F.date_add("a", 3).alias("depart_to"), F.col("a").alias("return_from"), F.date_add("a", 9).alias("return_to"), F.lit(3).alias("min_nights"), F.lit(6).alias("max_nights"))
    return fares.date_pairs(scopes)


@query(a.with_views(", r as (select *, row_number() over (partition by airline, dep_bucket order by price nulls last, depart_time, id) as k from v_fares) select airline, dep_bucket, price, depart_time, id from r where k = 1 order by price nulls last, depart_time, airline limit 10", P))
def select_outbound(spark, sf):
    return fares.select_outbound(a.fares(spark, sf).select("airline", "dep_bucket", "price", "depart_time", "id"), 10)


@query(a.with_views(", g as (select airline, ret_bucket, ret_stops, min(price) as min_price, count(*) as n from v_fares group by 1, 2, 3) select airline, ret_bucket, ret_stops, min_price, cast(sum(n) over (partition by airline, ret_bucket) as bigint) as n_itineraries from g", P))
def fare_cells(spark, sf):
    f = a.fares(spark, sf).withColumn("ret_airline", F.col("dep_bucket"))
    return fares.cells(f, ["airline"]).drop("return_airline")


@query(a.with_views("select distinct id, dep_bucket, ret_bucket, cast(hour(strptime(depart_time, '%H:%M')) // 3 as integer) as place, 'n' || cast(cast(substr(depart_time, 1, 2) as integer) * 60 + cast(substr(depart_time, 4, 2) as integer) as varchar) as minute from v_fares", P))
def bucket_label(spark, sf):
    f = a.fares(spark, sf)
    return f.select("id", "dep_bucket", "ret_bucket", dates.bucket_order(F.col("dep_bucket")).alias("place"), F.concat(F.lit("n"), dates.minutes_of(F.col("depart_time")).cast("string")).alias("minute")).distinct()


@query(a.with_views(", r as (select *, row_number() over (order by run_date desc) as b, count(*) over () as n from (select distinct run_date from v_fares)) select run_date from r where (b - 1) % ceil(n / 14.0) = 0", P))
def thinned_ticks(spark, sf):
    return rollup.thinned_ticks(a.fares(spark, sf).select("run_date").distinct(), "run_date")


@query("with s as (select min(o_totalprice) as lo, max(o_totalprice) as hi from orders) select cast(cast(greatest(0, lo - case when hi > lo then (hi - lo) * 0.1 else abs(hi) * 0.05 end) as decimal(38,6)) as double) as low, cast(cast(hi + case when hi > lo then (hi - lo) * 0.1 else abs(hi) * 0.05 end as decimal(38,6)) as double) as high from s")
def axis_limits(spark, sf):
    out = rollup.axis_limits(read(spark, sf, "orders"), "o_totalprice")
    return out.select(a.r6(F.col("low")).alias("low"), a.r6(F.col("high")).alias("high"))
