"""Inserts and upserts of the named tables, by their declared keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import dedupe_key
from ..schemas import FREE_NULLS, KEPT, KEYS
from .state import insert_absent, merge


def add(table: str, existing: DataFrame, new: DataFrame) -> DataFrame:
    """New rows of a table whose key is not there yet."""
    return insert_absent(existing, new, list(KEYS[table]), null_keys_repeat=table in FREE_NULLS)


def upsert(table: str, existing: DataFrame, new: DataFrame, newest: str | None = None) -> DataFrame:
    """A table after an upsert; its kept columns stay as first written (a revised macro value is ignored, its fetch time is not)."""
    return merge(existing, new, list(KEYS[table]), keep=list(KEPT.get(table, ())), newest=newest)


def add_quarter(existing: DataFrame, quarter: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to add, rows refused as their quarter is there); the printed total goes before the sum of the parts."""
    parts = F.col("land_ready") + F.col("being_built") + F.col("built_not_sold")
    complete = quarter.withColumn("total", F.coalesce("total", parts))
    known = existing.select("quarter")
    return complete.join(known, "quarter", "left_anti").select(*existing.columns), complete.join(known, "quarter", "left_semi").select(*existing.columns)


def total_mismatch(quarters: DataFrame, tolerance: int = 3000) -> DataFrame:
    """Quarters whose printed total is further from the sum of their rounded parts than rounding explains."""
    off = F.abs(F.col("total") - (F.col("land_ready") + F.col("being_built") + F.col("built_not_sold")))
    return quarters.withColumn("off", off).where(F.col("off") > tolerance)


def register_media(existing: DataFrame, files: DataFrame) -> DataFrame:
    """The media id of each file (account_id, sha256, path): that of an equal file of the account, else a new one."""
    known = existing.groupBy("account_id", "sha256").agg(F.min("media_id").alias("known_id"))
    new_id = F.sha1(F.concat_ws("|", "account_id", "sha256"))
    joined = files.join(known, ["account_id", "sha256"], "left")
    return joined.withColumn("media_id", F.coalesce("known_id", new_id)).withColumn("reused", F.col("known_id").isNotNull()).drop("known_id")


def add_coupons(existing: DataFrame, candidates: DataFrame, now: Column) -> DataFrame:
    """Validated candidates as coupon rows, with their dedupe key and a key-made id."""
    key = dedupe_key(F.col("merchant"), F.col("title"), F.col("expires_on").cast("string"))
    made = candidates.withColumns({"dedupe_key": key, "created_at": now, "updated_at": now, "uses_remaining": F.col("uses_total")})
    made = made.withColumn("id", F.sha1(F.concat_ws("|", "account_id", "dedupe_key", F.coalesce("source_ref", F.lit("")))))
    return insert_absent(existing, made.select(*existing.columns), ["id"])


def find_duplicate(coupons: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates with the earliest coupon of their dedupe key."""
    first = coupons.groupBy("dedupe_key").agg(F.min_by("id", F.struct("created_at", "id")).alias("duplicate_of"))
    return candidates.join(first, "dedupe_key", "left")


def add_accounts(existing: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accounts to add, refused): ids and external ids are unique."""
    taken = existing.where("chat_id is not null").select("chat_id")
    free = new.join(existing.select("account_id"), "account_id", "left_anti").join(taken, "chat_id", "left_anti").select(*existing.columns)
    return free, new.join(free.select("account_id"), "account_id", "left_anti").select(*existing.columns)


def purge_selection(coupons: DataFrame, today: Column, status: list[str] | None = None, merchant: str | None = None, older_than_days: int | None = None, ids: list[str] | None = None) -> DataFrame:
    """What a purge takes: all filters together. Unknown or foreign ids are an error."""
    found = F.lit(True)
    if status:
        found = found & F.col("status").isin(status)
    if merchant:
        found = found & F.contains(F.lower("merchant"), F.lit(merchant.lower()))
    if older_than_days is not None:
        found = found & (F.col("expires_on") < F.date_sub(today, older_than_days))
    if ids:
        have = {r.id for r in coupons.where(F.col("id").isin(ids)).select("id").collect()}  # at most the ids asked for
        if missing := sorted(set(ids) - have):
            raise LookupError(f"no such coupons: {missing}")
        found = found & F.col("id").isin(ids)
    return coupons.where(found)


def owned(path: Column, root: str, account: Column) -> Column:
    """Whether a path lies in an account's own folder, with no way up out of it."""
    inside = F.startswith(path, F.concat(F.lit(root.rstrip("/") + "/"), account, F.lit("/")))
    return inside & ~F.contains(path, F.lit("/../")) & ~F.endswith(path, F.lit("/.."))


def set_column(rows: DataFrame, where: Column, name: str, value: Column) -> DataFrame:
    return rows.withColumn(name, F.when(where, value).otherwise(F.col(name)))
