"""Spending queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import messages, rollup, state
from . import adapters as a
from .registry import query

V = "v_expenses"
_SUM = "coalesce(cast(sum(amount) as double), 0) as total, count(*) as n"


@query(a.with_views(f"select {_SUM} from v_expenses where ts >= timestamp '2024-01-01' and ts < timestamp '2024-02-01'", V))
def month_summary(spark, sf):
    return rollup.totals_by(a.expenses(spark, sf).where(rollup.spending_filter(month="2024-01")))


@query(a.with_views(f", c as (select category, {_SUM} from v_expenses group by 1) select category, total, n, cast(cast(100.0 * total / (select sum(total) from c) as decimal(38,6)) as double) as pct from c", V))
def by_category(spark, sf):
    return rollup.category_summary(a.expenses(spark, sf)).withColumn("pct", a.r6(F.col("pct")))


@query(a.with_views(f"select member, {_SUM} from v_expenses group by member", V))
def by_member(spark, sf):
    return rollup.totals_by(a.expenses(spark, sf), "member")


@query(a.with_views(", p as (select cast(ts as date) as day, category, cast(sum(amount) as double) as total, count(*) as n from v_expenses group by 1, 2), d as (select day, cast(sum(cast(total as decimal(38,2))) as double) as total, cast(sum(n) as bigint) as n from p group by 1) select * from d order by total desc, day desc limit 5", V))
def top_days(spark, sf):
    return rollup.top_days(a.expenses(spark, sf)).drop("categories")


@query(a.with_views(", p as (select cast(ts as date) as day, category, cast(sum(amount) as double) as total, count(*) as n from v_expenses group by 1, 2), d as (select day, cast(sum(cast(total as decimal(38,2))) as double) as total, cast(sum(n) as bigint) as n, '{' || string_agg('\"' || category || '\":' || total, ',' order by category) || '}' as categories from p group by 1) select * from d order by total desc, day desc limit 5", V))
def top_days_with_categories(spark, sf):
    return rollup.top_days(a.expenses(spark, sf))


@query(a.with_views(f"select strftime(ts, '%Y-%m') as month, {_SUM} from v_expenses where ts >= timestamp '2024-01-01' and ts < timestamp '2025-01-01' group by 1", V))
def year_months(spark, sf):
    return rollup.months(a.expenses(spark, sf).where(rollup.spending_filter(year="2024")))


@query(a.with_views(f", p as (select strftime(ts, '%Y-%m') as month, category, {_SUM} from v_expenses group by 1, 2) select month, category, total, n, cast(sum(cast(total as decimal(38,2))) over (partition by month) as double) as month_total from p", V))
def year_months_by_category(spark, sf):
    return rollup.months_by_category(a.expenses(spark, sf))


@query(a.with_views("select id, member, category, cast(amount as double) as amount, ts from v_expenses where lower(member) = '8' order by ts desc, id desc limit 20", V))
def list_expenses(spark, sf):
    return rollup.latest_expenses(a.expenses(spark, sf).where(rollup.spending_filter(member="8"))).select("id", "member", "category", "amount", "ts")


@query(a.with_views(f", c as (select keyword || category as category, {_SUM} from v_expenses group by 1), r as (select *, row_number() over (order by total desc, category) as k, count(*) over () as m from c) select case when k <= 7 or m <= 8 then category else 'Other' end as slice, cast(sum(cast(total as decimal(38,2))) as double) as total, cast(sum(n) as bigint) as n from r group by 1", V))
def fold_tail(spark, sf):
    e = a.expenses(spark, sf).withColumn("category", F.concat("keyword", "category"))
    return rollup.fold_tail(rollup.totals_by(e, "category"))


@query(a.with_views("select keyword, count(*) as n, cast(sum(amount) as double) as total, min(description) as example from v_expenses where category = 'Uncategorized' group by 1", V))
def unmapped(spark, sf):
    return rollup.unmapped(a.expenses(spark, sf))


@query(a.with_views(f", c as (select category, {_SUM} from v_expenses group by 1), r as (select category, total, dense_rank() over (order by total desc, category) as k from c) select category, total, cast(k as integer) as rank, case when k <= 3 then category else 'Other' end as heading from r", V))
def table_headings(spark, sf):
    return rollup.headings(rollup.totals_by(a.expenses(spark, sf), "category"))


@query(a.with_views(f", c as (select category, {_SUM} from v_expenses group by 1), m as (select strftime(ts, '%Y-%m') as month, category, {_SUM} from v_expenses group by 1, 2), r as (select category, row_number() over (order by total desc, category) as rank from c) select month, m.category, total, cast(rank as integer) as rank, coalesce(cast(sum(cast(total as decimal(38,2))) over (partition by month order by rank rows between unbounded preceding and 1 preceding) as double), 0) as bottom from m join r using (category)", V))
def stacked_months(spark, sf):
    e = a.expenses(spark, sf)
    return rollup.stacked(rollup.months_by_category(e).select("month", "category", "total"), rollup.totals_by(e, "category"))


@query(a.with_views("select distinct member from v_expenses", V))
def members(spark, sf):
    return a.expenses(spark, sf).select("member").distinct()


@query(r"""
with m as (select p_partkey % 500 as message_id, string_agg(p_name || ' $' || printf('%.2f', p_retailprice), '; ' order by p_partkey) as text from part group by 1),
c as (select message_id, unnest(string_split(text, '; ')) as raw, generate_subscripts(string_split(text, '; '), 1) - 1 as item_index from m)
select message_id, cast(item_index as integer) as item_index, raw, cast(regexp_extract(raw, '\$([0-9.]+)$', 1) as double) as amount from c
""")
def parse_messages(spark, sf):
    return messages.parse_messages(a.messages(spark, sf), r"[;\n、]+").select("message_id", "item_index", "raw", "amount")


@query(r"""
with m as (select p_partkey % 500 as message_id, string_agg(p_name || ' $' || printf('%.2f', p_retailprice), '; ' order by p_partkey) as text from part group by 1),
c as (select message_id, unnest(string_split(text, '; ')) as raw, generate_subscripts(string_split(text, '; '), 1) - 1 as item_index from m)
select message_id, 'Alice' as member, timestamp '2026-07-19 11:00:00' as ts, cast(item_index as integer) as item_index, raw, regexp_replace(raw, ' \$[0-9.]+$', '') as description, cast(regexp_extract(raw, '\$([0-9.]+)$', 1) as double) as amount from c
""")
def parse_messages_full(spark, sf):
    return messages.parse_messages(a.messages(spark, sf))


_KEYWORDS = {"steel": "Housing & Utilities", "red": "Shopping", "blue steel": "Beauty", "small": "Other", "part": "Education", "part 1": "Health", "and a box of nails": "Shopping"}


@query(r"""
with d as (select *, trim(regexp_replace(lower(description), '[^0-9a-z一-鿿]+', ' ', 'g')) as norm from (select p_partkey as id, p_name || case when p_partkey % 5 = 0 then ', and a box of nails' else '' end as description from part)),
k as (select * from (values ('steel', 'Housing & Utilities'), ('red', 'Shopping'), ('blue steel', 'Beauty'), ('small', 'Other'), ('part', 'Education'), ('part 1', 'Health'), ('and a box of nails', 'Shopping')) t(keyword, category)),
m as (select id, k.keyword, k.category, row_number() over (partition by id order by (k.keyword = norm) desc, length(k.keyword) desc, k.keyword) as n from d join k on contains(' ' || norm || ' ', ' ' || k.keyword || ' '))
select d.id, d.description, coalesce(m.keyword, d.norm) as keyword, coalesce(m.category, 'Uncategorized') as category from d left join m on d.id = m.id and m.n = 1
""")
def keyword_resolve(spark, sf):
    from ..session import read

    items = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.when(F.col("p_partkey") % 5 == 0, ", and a box of nails").otherwise("")).alias("description"))
    rows = ",".join(f"('{k}', '{c}')" for k, c in _KEYWORDS.items())
    return messages.resolve(items, spark.sql(f"select keyword, category from values {rows} as t(keyword, category)"), ["id"]).select("id", "description", "keyword", "category")


@query(a.with_views("select keyword, count(*) as hits from v_expenses group by 1", V))
def keyword_hits(spark, sf):
    e = a.expenses(spark, sf)
    table = e.select("keyword").distinct().withColumn("hits", F.lit(0).cast("long"))
    return state.add_hits(table, e).select("keyword", "hits")


@query(a.with_views("select member, category, cast(amount as double) as amount, ts, id from v_expenses where category <> 'click'", V))
def insert_absent(spark, sf):
    e = a.expenses(spark, sf).select("member", "category", "amount", "ts", "id")
    return state.insert_absent(e.where("category = 'click'"), e.unionByName(e), ["id"])


@query(a.with_views("select id, member, case when category = 'view' then 'new' else category end as category, cast(amount as double) as amount from v_expenses", V))
def merge_upsert(spark, sf):
    e = a.expenses(spark, sf).select("id", "member", "category", "amount")
    return state.merge(e, e.where("category = 'view'").withColumns({"category": F.lit("new"), "member": F.lit("x")}), ["id"], keep=["member"])


@query(a.with_views(" select id from v_expenses where category <> 'Uncategorized'", V))
def ledger_pending(spark, sf):
    e = a.expenses(spark, sf).select("id", "category")
    stamps = e.where("category = 'Uncategorized'").select(F.lit("expenses").alias("domain"), F.col("id").cast("string").alias("key"), F.lit(None).cast("timestamp").alias("stamped_at"))
    return state.Ledger(stamps, "expenses").pending(e, F.col("id")).select("id")


@query(a.with_views(", r as (select *, row_number() over (partition by member order by id desc) as k from v_expenses) select member, id, category from r where k <= 3", V))
def latest_per_key(spark, sf):
    return rollup.latest_n(a.expenses(spark, sf).select("member", "id", "category"), ["member"], "id", 3)
