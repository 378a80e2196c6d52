"""Source health, throttling, budgets, staleness and zero yields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def throttled(state: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """Sources scanned less than their interval ago, with the time they are free again."""
    joined = sources.join(state, "source", "left")
    free = F.col("last_scan_at") + F.make_interval(mins=F.col("min_interval_minutes"))
    return joined.withColumn("until", free).where(free > now)


def stale(fetched: DataFrame, keys: DataFrame, now: Column, hours: int = 12) -> DataFrame:
    """Keys never fetched, or not within some hours."""
    last = fetched.groupBy("series").agg(F.max("fetched_at").alias("last"))
    return keys.join(last, "series", "left").where(F.col("last").isNull() | (now >= F.col("last") + F.expr(f"interval {hours} hours")))


def budgeted(wanted: DataFrame, budget: int, order: list[Column]) -> DataFrame:
    """The first of what is wanted, the rest named as deferred."""
    rank = F.row_number().over(Window.orderBy(*order))
    return wanted.withColumn("rank", rank).withColumn("deferred", F.col("rank") > budget)


def detail_budget(items: DataFrame, per_source: int) -> DataFrame:
    """The first items of each source get their page read."""
    rank = F.row_number().over(Window.partitionBy("source").orderBy("position"))
    return items.withColumn("read_detail", rank <= per_source)


def excluded(items: DataFrame, keywords: list[str]) -> Column:
    text = F.lower(F.concat_ws(" ", "title", "summary", "date_text"))
    found = F.lit(False)
    for k in keywords:
        found = found | F.contains(text, F.lit(k.lower()))
    return found


def after_scan(state: DataFrame, results: DataFrame) -> DataFrame:
    """Source state after a scan (``results``: source, ok, yielded, at).

    The yield last seen stays when nothing came, so that a source gone silent shows;
    failures count up and success clears them.
    """
    joined = state.join(results, "source", "full")
    yielded = F.coalesce("yielded", F.lit(0))
    ok = F.col("ok")
    return joined.select(
        "source",
        F.when(ok, F.col("at")).otherwise(F.col("last_scan_at")).alias("last_scan_at"),
        F.when(ok & (yielded > 0), yielded).otherwise(F.coalesce("recent_yield", F.lit(0))).alias("recent_yield"),
        F.when(ok, 0).when(ok.isNull(), F.coalesce("failures", F.lit(0))).otherwise(F.coalesce("failures", F.lit(0)) + 1).alias("failures"),
        F.coalesce(ok & (yielded == 0) & (F.coalesce("recent_yield", F.lit(0)) > 0), F.lit(False)).alias("went_silent"),
    )


def health(sources: DataFrame, state: DataFrame) -> DataFrame:
    """Every configured source with its state, zeros where it was never scanned."""
    return sources.join(state, "source", "left").withColumns({"failures": F.coalesce("failures", F.lit(0)), "recent_yield": F.coalesce("recent_yield", F.lit(0))})


def failure_streak(runs: DataFrame, key: str) -> DataFrame:
    """Failed runs since each key's last good one (``runs``: key, at, ok)."""
    last_ok = runs.groupBy(key).agg(F.max(F.when(F.col("ok"), F.col("at"))).alias("last_ok"))
    return runs.join(last_ok, key).groupBy(key).agg(F.count_if(~F.col("ok") & (F.col("last_ok").isNull() | (F.col("at") > F.col("last_ok")))).alias("streak"))


def last_success(runs: DataFrame) -> DataFrame:
    return runs.where("status = 'ok'").groupBy("kind").agg(F.max("started_at").alias("last_success"))


def horizon(events: DataFrame, today: Column, days: int) -> DataFrame:
    """Events from today up to some days ahead that have not been reported."""
    return events.where(F.col("notified_at").isNull() & F.col("event_date").between(today, F.date_add(today, days))).withColumn("days_left", F.datediff("event_date", today))


def ordered_union(*parts: DataFrame, key: str = "ticker") -> DataFrame:
    """Distinct keys of several sources, in the order of their first source."""
    tagged = [p.select(key, F.lit(n).alias("priority")) for n, p in enumerate(parts)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    return out.groupBy(key).agg(F.min("priority").alias("priority"))


def sections(stories: DataFrame, categories: list[str]) -> DataFrame:
    """Stories by section in configured order, other sections last; empty ones do not appear."""
    place = F.array_position(F.array(*[F.lit(c) for c in categories]), F.col("category"))
    return stories.withColumn("section", F.when(place > 0, place).otherwise(len(categories) + 1))


# Markets by symbol ending.
MARKETS = {".HK": ("HK", "Asia/Hong_Kong"), ".SS": ("CN", "Asia/Shanghai"), ".SZ": ("CN", "Asia/Shanghai"), ".T": ("JP", "Asia/Tokyo"), ".L": ("UK", "Europe/London")}
HOME = ("US", "America/New_York")


def market_of(ticker: Column) -> Column:
    up = F.upper(F.trim(ticker))
    out = None
    for ending, (label, zone) in MARKETS.items():
        value = F.struct(F.lit(label).alias("market"), F.lit(zone).alias("zone"))
        out = F.when(F.endswith(up, F.lit(ending)), value) if out is None else out.when(F.endswith(up, F.lit(ending)), value)
    return out.otherwise(F.struct(F.lit(HOME[0]).alias("market"), F.lit(HOME[1]).alias("zone")))


def next_session(day: Column) -> Column:
    """The next weekday: what stands in where no exchange calendar is given."""
    return F.date_add(day, F.when(F.weekday(day) == 4, 3).when(F.weekday(day) == 5, 2).otherwise(1))


def next_open(tickers: DataFrame, sessions: DataFrame, after: Column) -> DataFrame:
    """The next opening of each ticker's market, from a calendar (market, open_at)."""
    labelled = tickers.withColumn("market", market_of(F.col("ticker"))["market"])
    upcoming = sessions.where(F.col("open_at") > after).groupBy("market").agg(F.min("open_at").alias("open_at"))
    return labelled.join(upcoming, "market", "left")
