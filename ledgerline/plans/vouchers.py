"""Coupons, media, accounts, lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coupons, rollup
from ..session import read
from . import adapters as a
from .registry import query

C, D = "v_coupons", "v_media"
_TODAY = "1998-05-06"  # a Wednesday


def _today():
    return F.lit(_TODAY).cast("date")


@query(a.with_views("select status, count(*) as n from v_coupons group by 1", C))
def status_histogram(spark, sf):
    return rollup.histogram(a.coupons(spark, sf), "status")


@query(a.with_views(f"select id, account_id, merchant, expires_on, status from v_coupons where status not in ('expired', 'void') and contains(lower(merchant), 'urgent') and expires_on <= date '{_TODAY}' + 30 order by expires_on, id limit 50", C))
def list_coupons(spark, sf):
    return coupons.listed(a.coupons(spark, sf).select("id", "account_id", "merchant", "expires_on", "status"), _today(), merchant="URGENT", within=30)


@query(a.with_views(f"select id, expires_on, case id % 4 when 0 then '' when 3 then 'min_spend' when 1 then 'channel' else 'location' end as caveats from v_coupons where status = 'active' and expires_on >= date '{_TODAY}'", C))
def usable_now(spark, sf):
    at = F.lit(f"{_TODAY} 14:30:00").cast("timestamp_ntz")
    none = F.lit(None).cast("string")
    return coupons.usable_now(a.coupons(spark, sf), at, none, none).select("id", "expires_on", F.array_join("caveats", ",").alias("caveats"))


@query(a.with_views(f"select id, expires_on from v_coupons where status = 'active' and expires_on >= date '{_TODAY}' and id % 4 not in (0, 1, 2) or (status = 'active' and expires_on >= date '{_TODAY}' and id % 4 = 2)", C))
def usable_in_context(spark, sf):
    at = F.lit(f"{_TODAY} 14:31:00").cast("timestamp_ntz")
    return coupons.usable_now(a.coupons(spark, sf), at, F.lit("dine-in"), F.lit("central")).select("id", "expires_on")


@query(a.with_views(f"select id, account_id, expires_on, case when expires_on = date '{_TODAY}' then 'expiry_day' else 'pre_expiry' end as tag, cast(expires_on - date '{_TODAY}' as integer) as days_left from v_coupons where status = 'active' and expires_on between date '{_TODAY}' and date '{_TODAY}' + 3", C))
def alerts_due(spark, sf):
    return coupons.due(a.coupons(spark, sf), _today()).select("id", "account_id", "expires_on", "tag", "days_left")


@query(a.with_views(f"select id, case when expires_on < date '{_TODAY}' and status in ('active', 'needs_review') then 'expired' else status end as status, expires_on < date '{_TODAY}' and status in ('active', 'needs_review') as swept from v_coupons", C))
def expiry_sweep(spark, sf):
    return coupons.swept(a.coupons(spark, sf), _today()).select("id", "status", "swept")


@query(a.with_views("select account_id, media_id, count(*) filter (where status = 'used') as n_purged, count(*) filter (where status <> 'used') as n_kept, count(*) filter (where status <> 'used') = 0 as released from v_coupons where media_id is not null group by 1, 2 having count(*) filter (where status = 'used') > 0", C))
def purge_manifest(spark, sf):
    return coupons.purge_manifest(a.coupons(spark, sf), F.col("status") == "used")


@query(a.with_views("select id, media_id, account_id from v_coupons c where media_id is not null and not exists (select 1 from v_media m where m.media_id = c.media_id and m.account_id = c.account_id)", C, D))
def dangling_refs(spark, sf):
    return coupons.dangling(a.coupons(spark, sf), a.media(spark, sf)).select("id", "media_id", "account_id")


@query(a.with_views("select media_id, account_id from v_media m where not exists (select 1 from v_coupons c where c.media_id = m.media_id)", C, D))
def unreferenced_media(spark, sf):
    return coupons.unreferenced(a.media(spark, sf), a.coupons(spark, sf)).select("media_id", "account_id")


@query(a.with_views("select id, account_id from v_coupons c where not exists (select 1 from v_media m where m.account_id = c.account_id)", C, D))
def orphan_rows(spark, sf):
    return coupons.orphans(a.coupons(spark, sf), a.media(spark, sf)).select("id", "account_id")


_CAND = ", c as (select id, account_id, case when id % 11 = 0 then '' else merchant end as merchant, title, expires_on, (id % 10) / 10.0 as confidence, id % 6 = 0 as assumed, cast(id % 3 as integer) + 1 as stated, id // 100 as doc from v_coupons), e as (select min(id) as dup, merchant, title, expires_on from v_coupons where status = 'used' group by 2, 3, 4), n as (select doc, count(*) as n_found from c group by 1)"


@query(a.with_views(_CAND + ", r as (select c.*, n_found, dup, array_to_string(list_filter([case when stated <> n_found then 'count' end, case when c.merchant = '' then 'merchant' end, case when confidence < 0.8 then 'confidence' end, case when assumed then 'assumed' end, case when dup is not null then 'duplicate' end], lambda x: x is not null), ',') as reasons from c join n using (doc) left join e on lower(e.merchant) = lower(c.merchant) and e.title = c.title and e.expires_on = c.expires_on) select id, reasons, case when reasons = '' then 'active' else 'needs_review' end as status from r", C))
def review_reasons(spark, sf):
    from ..functions.text import dedupe_key

    all_rows = a.coupons(spark, sf)
    c = all_rows.select("id", F.when(F.col("id") % 11 == 0, "").otherwise(F.col("merchant")).alias("merchant"), "title", "expires_on", ((F.col("id") % 10) / 10.0).alias("confidence"), (F.col("id") % 6 == 0).alias("assumed"), ((F.col("id") % 3).cast("int") + 1).alias("stated"), F.floor(F.col("id") / 100).alias("doc"))
    e = all_rows.where("status = 'used'").select("id", dedupe_key(F.col("merchant"), F.col("title"), F.col("expires_on").cast("string")).alias("dedupe_key"), F.col("id").alias("created_at"))
    out = coupons.review_reasons(c, e)
    kind = F.transform("reasons", lambda r: F.when(r.startswith("stated"), "count").when(r.startswith("merchant"), "merchant").when(r.startswith("confidence"), "confidence").when(r.startswith("expiry"), "assumed").otherwise("duplicate"))
    return out.select("id", F.array_join(kind, ",").alias("reasons"), "status")


@query(a.with_views(", b as (select account_id, status, count(*) as n from v_coupons group by 1, 2), s as (select account_id, cast(sum(n) as bigint) as n_coupons from b group by 1), m as (select account_id, count(*) as n_media from v_media group by 1) select account_id, n_coupons, coalesce(n_media, 0) as n_media from s left join m using (account_id)", C, D))
def account_summary(spark, sf):
    return coupons.account_summary(a.coupons(spark, sf), a.media(spark, sf)).drop("by_status")


_DUE = f"v_coupons as ({a.SQL[C]}), d as (select *, case when expires_on = date '{_TODAY}' then 'expiry_day' else 'pre_expiry' end as tag from v_coupons where status = 'active' and expires_on between date '{_TODAY}' and date '{_TODAY}' + 30)"


@query("with " + _DUE + ", p as (select account_id, count(*) as n, '[' || string_agg('{\"expires_on\":\"' || expires_on || '\",\"id\":' || id || ',\"tag\":\"' || tag || '\"}', ',' order by expires_on, id) || ']' as coupons from d group by 1), a as (select cast(c_custkey as varchar) as account_id, case when c_custkey % 3 <> 0 then c_custkey end as chat_id from customer) select account_id, n, coupons, chat_id, case when chat_id is null then 'skipped' else 'due' end as status from p join a using (account_id)")
def alert_payloads(spark, sf):
    accounts = read(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("account_id"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey")).alias("chat_id"))
    return coupons.alerts(a.coupons(spark, sf), accounts, _today(), 30)


#: Each event in turn: one use, then two more, an undo in time, an expiry.
_EVENTS = "with o as (select o_orderkey as id, case o_orderstatus when 'F' then 'used' when 'O' then 'active' else 'needs_review' end as status from orders)"


@query(_EVENTS + " select id, case when status = 'used' then case when id % 3 = 2 then 'active' else 'used' end when id % 3 = 0 then 'used' when id % 3 = 1 then 'expired' else 'active' end as status, case when status = 'used' then 3 when id % 3 = 0 then 0 when id % 3 = 1 then 2 else 3 end as remaining from o")
def lifecycle_fold(spark, sf):
    c = a.coupons(spark, sf)
    e = c.select("id", F.explode(F.when(F.col("id") % 3 == 0, F.array(F.struct(F.lit(1).alias("seq"), F.lit("use").alias("kind"), F.lit("1").alias("arg")), F.struct(F.lit(2).alias("seq"), F.lit("use").alias("kind"), F.lit("2").alias("arg")))).when(F.col("id") % 3 == 1, F.array(F.struct(F.lit(1).alias("seq"), F.lit("use").alias("kind"), F.lit("1").alias("arg")), F.struct(F.lit(2).alias("seq"), F.lit("expire").alias("kind"), F.lit(None).cast("string").alias("arg")))).otherwise(F.array(F.struct(F.lit(1).alias("seq"), F.lit("use").alias("kind"), F.lit("1").alias("arg")), F.struct(F.lit(2).alias("seq"), F.lit("unuse").alias("kind"), F.lit(None).cast("string").alias("arg"))))).alias("x"))
    e = e.select("id", F.lit("2026-08-05 12:00:00").cast("timestamp_ntz").alias("at"), F.col("x.seq").cast("long").alias("seq"), "x.kind", "x.arg")
    return coupons.lifecycle(c, e).select("id", "status", "remaining")


@query("select cast(count(*) filter (where not valid) as bigint) as rejected, cast(count(*) filter (where valid) as bigint) as valid from (select o_orderkey % 4 <> 3 as valid from orders)")
def schema_rejects(spark, sf):
    c = a.coupons(spark, sf)
    bad = F.transform("conditions", lambda x: F.struct(x["kind"].alias("kind"), F.when(x["kind"] == "min_spend", F.lit(None).cast("map<string,string>")).otherwise(x["params"]).alias("params"), x["text"].alias("text")))
    valid, rejected = coupons.split_valid(c.withColumn("conditions", bad))
    both = rejected.select(F.lit(1).alias("r")).unionByName(valid.select(F.lit(0).alias("r")))
    return both.agg(F.count_if(F.col("r") == 1).alias("rejected"), F.count_if(F.col("r") == 0).alias("valid"))
