"""Coupons: three-valued conditions, due dates, review, lifecycle, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import casefold, dedupe_key

KINDS = ("channel", "time_window", "date_window", "location", "min_spend", "payment_method", "other")
ADVISORY = ("min_spend", "payment_method", "other")
CONDITIONS = "array<struct<kind:string,params:map<string,string>,text:string>>"


def json_list(value: Column) -> Column:
    """A nested array arrives as JSON text."""
    return F.from_json(value, "array<string>")


def _minutes(clock: Column) -> Column:
    at = F.regexp_extract(clock, r"^(\d{1,2}):(\d{2})$", 1).try_cast("int") * 60 + F.regexp_extract(clock, r"^(\d{1,2}):(\d{2})$", 2).try_cast("int")
    return F.when(at < 1440, at)


def verdict(condition: Column, at: Column, channel: Column, location: Column) -> Column:
    """PASS, FAIL or UNKNOWN of one condition in a context; unknown context never fails."""
    params = condition["params"]
    allowed = json_list(params["allow"])
    by_channel = F.when(channel.isNull(), "UNKNOWN").when(F.array_contains(allowed, channel), "PASS").otherwise("FAIL")
    days = json_list(params["days"])
    second = F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)
    lo, hi = _minutes(F.coalesce(params["from"], F.lit("00:00"))) * 60, _minutes(F.coalesce(params["to"], F.lit("23:59"))) * 60
    inside = F.when(lo <= hi, second.between(lo, hi)).otherwise((second >= lo) | (second <= hi))
    by_time = (
        F.when((F.size(days) > 0) & ~F.array_contains(days, F.weekday(at).cast("string")), "FAIL")
        .when(lo.isNull() | hi.isNull(), "UNKNOWN").when(inside, "PASS").otherwise("FAIL")
    )
    today = F.to_date(at)
    from_day, to_day = F.try_to_date(params["from"]), F.try_to_date(params["to"])
    by_date = F.when(F.coalesce(today < from_day, F.lit(False)) | F.coalesce(today > to_day, F.lit(False)), "FAIL").otherwise("PASS")
    places = F.array_compact(F.concat(F.coalesce(json_list(params["branches"]), F.array().cast("array<string>")), F.array(params["region"])))
    needle = casefold(F.trim(location))
    near = F.exists(places, lambda p: F.contains(casefold(p), needle) | F.contains(needle, casefold(p)))
    by_place = F.when(location.isNull() | (needle == "") | (F.size(places) == 0), "UNKNOWN").when(near, "PASS").otherwise("FAIL")
    kind = condition["kind"]
    return F.when(kind == "channel", by_channel).when(kind == "time_window", by_time).when(kind == "date_window", by_date).when(kind == "location", by_place).otherwise("UNKNOWN")


def usable_now(coupons: DataFrame, at: Column, channel: Column, location: Column) -> DataFrame:
    """Active, unexpired coupons without a failing condition; conditions of unknown outcome are caveats."""
    judged = F.transform("conditions", lambda c: F.struct(verdict(c, at, channel, location).alias("v"), c["kind"].alias("kind")))
    live = coupons.where((F.col("status") == "active") & (F.col("expires_on") >= F.to_date(at))).withColumn("judged", judged)
    return live.where(~F.exists("judged", lambda j: j["v"] == "FAIL")).withColumn("caveats", F.transform(F.filter("judged", lambda j: j["v"] == "UNKNOWN"), lambda j: j["kind"])).drop("judged")


def invalid_reason(condition: Column) -> Column:
    """Why a condition is not valid; null if it is."""
    p, kind = condition["params"], condition["kind"]
    return (
        F.when(~kind.isin(list(KINDS)) | kind.isNull(), "unknown kind")
        .when((kind == "channel") & ~F.coalesce(F.size(json_list(p["allow"])) > 0, F.lit(False)), "channel needs allow")
        .when((kind == "time_window") & (_minutes(F.coalesce(p["from"], F.lit("00:00"))).isNull() | _minutes(F.coalesce(p["to"], F.lit("23:59"))).isNull()), "bad time")
        .when((kind == "time_window") & F.exists(F.coalesce(json_list(p["days"]), F.array().cast("array<string>")), lambda d: ~d.isin(*[str(i) for i in range(7)])), "bad weekday")
        .when((kind == "date_window") & ((p["from"].isNotNull() & F.try_to_date(p["from"]).isNull()) | (p["to"].isNotNull() & F.try_to_date(p["to"]).isNull())), "bad date")
        .when((kind == "min_spend") & p["amount"].try_cast("double").isNull(), "min_spend needs amount")
    )


def split_valid(coupons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with the first reason)."""
    reasons = F.array_compact(F.transform("conditions", invalid_reason))
    marked = coupons.withColumn("reason", F.get(reasons, F.lit(0)))
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def listed(coupons: DataFrame, today: Column, status: list[str] | None = None, merchant: str | None = None, within: int | None = None, limit: int = 50) -> DataFrame:
    found = F.col("status").isin(status) if status else ~F.col("status").isin("expired", "void")
    if merchant:
        found = found & F.contains(F.lower("merchant"), F.lit(merchant.lower()))
    if within is not None:
        found = found & (F.col("expires_on") <= F.date_add(today, within))
    return coupons.where(found).orderBy("expires_on", "id").limit(limit)


def due(coupons: DataFrame, today: Column, within: int = 3) -> DataFrame:
    """Active coupons that expire today or within some days, tagged."""
    live = coupons.where((F.col("status") == "active") & F.col("expires_on").between(today, F.date_add(today, within)))
    return live.withColumn("tag", F.when(F.col("expires_on") == today, "expiry_day").otherwise("pre_expiry")).withColumn("days_left", F.datediff("expires_on", today))


def alerts(coupons: DataFrame, accounts: DataFrame, today: Column, within: int = 3) -> DataFrame:
    """What is due, gathered for each account; accounts without a chat are skipped."""
    per = due(coupons, today, within).groupBy("account_id").agg(F.count("*").alias("n"), F.to_json(F.sort_array(F.collect_list(F.struct("expires_on", "id", "tag")))).alias("coupons"))
    return per.join(accounts, "account_id").withColumn("status", F.when(F.col("chat_id").isNull(), "skipped").otherwise("due"))


def swept(coupons: DataFrame, today: Column) -> DataFrame:
    """Past-dated coupons expire; doing it again changes nothing."""
    past = (F.col("expires_on") < today) & F.col("status").isin("active", "needs_review")
    return coupons.withColumns({"status": F.when(past, "expired").otherwise(F.col("status")), "swept": past})


def review_reasons(candidates: DataFrame, existing: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Candidates with their reasons for review (five kinds) and the status that follows.

    ``candidates``: doc, stated, merchant, title, expires_on, confidence, assumed;
    ``existing``: id, dedupe_key, created_at. A count that differs flags every candidate of its document.
    """
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy("doc"))
    first = existing.groupBy("dedupe_key").agg(F.min_by("id", "created_at").alias("duplicate_of"))
    keyed = candidates.withColumn("n_found", n).withColumn("dedupe_key", dedupe_key(F.coalesce("merchant", F.lit("")), F.col("title"), F.coalesce(F.col("expires_on").cast("string"), F.lit(""))))
    joined = keyed.join(first, "dedupe_key", "left")
    reasons = F.array_compact(F.array(
        F.when(F.col("stated") != F.col("n_found"), F.format_string("stated %d coupons but extracted %d", F.col("stated"), F.col("n_found"))),
        F.when(F.trim(F.coalesce("merchant", F.lit(""))) == "", "merchant missing"),
        F.when(F.col("confidence") < threshold, F.format_string("confidence %.2f below %.2f", F.col("confidence"), F.lit(threshold))),
        F.when(F.col("assumed"), "expiry date was assumed, not printed"),
        F.when(F.col("duplicate_of").isNotNull(), F.concat(F.lit("looks like a duplicate of "), F.col("duplicate_of").cast("string"))),
    ))
    return joined.withColumn("reasons", reasons).withColumn("status", F.when(F.size("reasons") > 0, "needs_review").otherwise("active"))


# --- lifecycle -------------------------------------------------------------


def transition(state: Column, event: Column, undo_hours: int = 24) -> Column:
    """The state (status, remaining, total, used_at, errors) after one event (kind, at, arg)."""
    status, kind = state["status"], event["kind"]
    left = F.greatest(F.lit(0), state["remaining"] - F.greatest(F.lit(1), F.coalesce(event["arg"].try_cast("int"), F.lit(1))))
    spent = left == 0
    late = state["used_at"].isNotNull() & (event["at"] > state["used_at"] + F.expr(f"interval {undo_hours} hours"))

    def to(new: Column, remaining: Column | None = None, used_at: Column | None = None, errors: Column | None = None) -> Column:
        return F.struct(new.alias("status"), (state["remaining"] if remaining is None else remaining).cast("int").alias("remaining"), state["total"].alias("total"), (state["used_at"] if used_at is None else used_at).alias("used_at"), (state["errors"] if errors is None else errors).cast("int").alias("errors"))

    same, none = to(status), F.lit(None).cast("timestamp_ntz")
    wrong = to(status, errors=state["errors"] + 1)
    return (
        F.when((kind == "use") & (status == "used"), same)
        .when((kind == "use") & status.isin("active", "needs_review"), to(F.when(spent, F.lit("used")).otherwise(F.lit("active")), left, F.when(spent, event["at"])))
        .when((kind == "unuse") & status.isin("used", "active") & ~F.coalesce(late, F.lit(False)), to(F.lit("active"), state["total"], none))
        .when(kind == "void", to(F.lit("void")))
        .when((kind == "extend") & ~status.isin("used", "void"), to(F.when(status == "expired", F.lit("active")).otherwise(status)))
        .when((kind == "expire") & status.isin("active", "needs_review"), to(F.lit("expired")))
        .when((kind == "resolve") & (status == "needs_review") & event["arg"].isin("active", "void"), to(event["arg"]))
        .otherwise(wrong)
    )


def lifecycle(coupons: DataFrame, events: DataFrame, undo_hours: int = 24) -> DataFrame:
    """The status of each coupon after its events in order: a fold over one array per coupon, in the JVM."""
    per = events.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", "seq", "kind", "arg"))).alias("log"))
    joined = coupons.join(per, "id", "left")
    start = F.struct(F.col("status").alias("status"), F.col("uses_total").cast("int").alias("remaining"), F.col("uses_total").cast("int").alias("total"), F.lit(None).cast("timestamp_ntz").alias("used_at"), F.lit(0).alias("errors"))
    empty = F.expr("cast(array() as array<struct<at:timestamp_ntz,seq:bigint,kind:string,arg:string>>)")
    after = F.aggregate(F.coalesce("log", empty), start, lambda s, e: transition(s, e, undo_hours))
    return joined.select("id", after.alias("s")).select("id", "s.status", "s.remaining", "s.used_at", "s.errors")


# --- references ------------------------------------------------------------


def dangling(coupons: DataFrame, media: DataFrame) -> DataFrame:
    """Coupons whose media is missing or another account's."""
    return coupons.where("media_id is not null").join(media.select("media_id", "account_id"), ["media_id", "account_id"], "left_anti")


def unreferenced(media: DataFrame, coupons: DataFrame) -> DataFrame:
    return media.join(coupons.select("media_id"), "media_id", "left_anti")


def orphans(rows: DataFrame, accounts: DataFrame) -> DataFrame:
    return rows.join(accounts.select("account_id"), "account_id", "left_anti")


def purge_manifest(coupons: DataFrame, selected: Column) -> DataFrame:
    """Media of selected coupons: how many references go, how many stay, and whether the file is released.

    One pass that counts both sides, instead of a lookup for each file.
    """
    per = coupons.where("media_id is not null").groupBy("account_id", "media_id").agg(F.count_if(selected).alias("n_purged"), F.count_if(~selected).alias("n_kept"))
    return per.where("n_purged > 0").withColumn("released", F.col("n_kept") == 0)


def cascade(account: str, *children: DataFrame) -> list[DataFrame]:
    """The rows that remain in each child table once an account is deleted."""
    return [c.where(F.col("account_id") != account) for c in children]


def account_summary(coupons: DataFrame, media: DataFrame) -> DataFrame:
    """Coupons by status and media of every account."""
    by = coupons.groupBy("account_id", "status").agg(F.count("*").alias("n"))
    per = by.groupBy("account_id").agg(F.sum("n").alias("n_coupons"), F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n"))))).alias("by_status"))
    return per.join(media.groupBy("account_id").agg(F.count("*").alias("n_media")), "account_id", "left").withColumn("n_media", F.coalesce("n_media", F.lit(0)))


class Scoped:
    """Tables as one account sees them: every read is filtered, so a foreign id is not found."""

    def __init__(self, account: str, **tables: DataFrame):
        self.account, self.tables = account, tables

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name].where(F.col("account_id") == self.account)

    def find(self, name: str, row_id: str) -> DataFrame:
        return self[name].where(F.col("id") == row_id)

