"""Composed reports: digest, desk report, alerts, brief. Nothing is stamped but by ``commit`` steps of the caller."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify
from ..functions.text import signature
from ..operators import asof, cluster, groups, scans, setups, state

NARRATIVE = ("failed", "triggered", "coiled")


def pending_news(news: DataFrame, tickers: DataFrame | None = None) -> DataFrame:
    """Unreported, unsuppressed news, of some tickers; an empty list of tickers gives none."""
    rows = news.where(F.col("notified_at").isNull() & ~F.col("suppressed"))
    return rows if tickers is None else rows.join(tickers.select("ticker").distinct(), "ticker", "left_semi")


def stories(news: DataFrame, held: DataFrame | None = None, threshold: float = 0.7, normal: str = "title") -> DataFrame:
    """News clustered per ticker and scored: one row a story, with its copies' ids and outlets.

    ``normal`` is the column of normal titles that words are taken from.
    """
    worded = news.withColumn("words", signature(F.lower(normal), company=True))
    items = worded.select("id", "source", "url", "words", "ticker")
    joined = worded.join(cluster.cluster(items, "ticker", threshold, same_source_urls=True), "id")
    scored = F.when(F.col("sentiment_score").isNotNull(), F.struct("id", "sentiment_label"))
    per = joined.groupBy("ticker", "story_id").agg(
        F.min_by("title", "id").alias("title"), F.min_by("url", "id").alias("url"), F.sort_array(F.collect_list("id")).alias("ids"),
        F.sort_array(F.collect_list(F.struct("id", "source"))).alias("s"), F.sort_array(F.collect_set("peer_of")).alias("peers"), F.min_by("peer_of", "id").alias("peer_of"),
        F.avg("sentiment_score").alias("sentiment"), F.min(scored)["sentiment_label"].alias("sentiment_label"), F.count("sentiment_score").alias("scored_copies"),
    )
    if held is not None:
        per = per.join(held.select("ticker", F.lit(True).alias("is_held")).distinct(), "ticker", "left")
    else:
        per = per.withColumn("is_held", F.lit(False))
    outlets = F.array_distinct(F.transform("s", lambda x: x["source"]))
    per = per.withColumn("event_class", classify.classify(F.col("title"))).withColumn("sources", outlets)
    judged = per.withColumn("v", classify.assess(F.col("event_class"), F.col("sources"), F.col("is_held"), F.col("peer_of")))
    return judged.select(
        "ticker", "story_id", "title", "url", "ids", "sources", "event_class", "v.score", "v.band", F.col("v.reasons").alias("why"), F.bround("sentiment", 3).alias("sentiment"), "sentiment_label", "scored_copies",
        F.when(F.size("peers") == 1, F.to_json(F.array(F.get("peers", F.lit(0))))).when(F.size("peers") > 1, F.to_json("peers")).alias("about_competitor"),
    )


def recent_stories(news: DataFrame, ticker: str, since: Column, **how) -> DataFrame:
    """A ticker's stories since a time, reported or not; stamps nothing."""
    return stories(news.where((F.col("ticker") == ticker) & (F.col("first_seen_at") >= since)), **how)


def news_by_sector(found: DataFrame, members: DataFrame) -> DataFrame:
    """Stories in the sector of their ticker; of two sectors, in both."""
    return found.join(members, "ticker").select("sector", "ticker", "story_id", "title", "score")


@dataclass
class Report:
    """The parts of a desk report as frames; ``capped`` stories alone may be stamped."""

    setups: DataFrame
    status_lines: DataFrame
    capped: DataFrame
    events: DataFrame
    sectors: DataFrame
    standings: DataFrame
    macro: DataFrame

    def stamps(self, now: Column) -> DataFrame:
        """Ledger rows of what the report says: the stories that made the cap, with all their copies, and the events."""
        told = self.capped.select(F.lit("news").alias("domain"), F.explode(F.transform("ids", lambda i: i.cast("string"))).alias("key"))
        due = self.events.select(F.lit("events").alias("domain"), F.concat_ws("|", "ticker", "kind", F.col("event_date").cast("string")).alias("key"))
        return told.unionByName(due).withColumn("stamped_at", now)

    def quiet(self) -> bool:
        """Whether there is nothing to say: three probes of at most one row."""
        return not any(df.limit(1).count() for df in (self.setups, self.capped, self.events, self.macro))


def desk_report(bars: DataFrame, previous: DataFrame | None, news: DataFrame, events: DataFrame, members: DataFrame, readings: DataFrame, moves: DataFrame, today: Column, held: DataFrame | None = None, floor: int = 0, cap: int = 12, horizon: int = 14, sessions: int = 30, thresholds: setups.Thresholds | None = None) -> Report:
    """All parts of the daily report. Stories are capped before anything is stamped: what is held back stays pending."""
    scanned = setups.scan(bars, previous, thresholds)
    told = F.col("stage").isin(list(NARRATIVE)) & F.coalesce("within_horizon", F.lit(False))
    from ..functions.series import Bars

    returns = bars.withColumn("ret", Bars().horizon_return(sessions)).groupBy("ticker").agg(F.max_by("ret", "day").alias("ret"))
    view = groups.sector_view(members, returns)
    return Report(
        scanned.where(told).orderBy(F.desc("score"), "ticker"),
        scanned.where(~told).select("ticker", setups.status_line().alias("line")),
        cluster.ranked(stories(pending_news(news), held), floor, cap),
        scans.horizon(events, today, horizon), view, groups.standing(view, members, returns), asof.changed_since_reported(readings, moves),
    )


def position_alerts(news: DataFrame, events: DataFrame, held: DataFrame, today: Column, cap: int = 12, horizon: int = 14) -> tuple[DataFrame, DataFrame]:
    """(stories, events) of open positions alone."""
    return cluster.ranked(stories(pending_news(news, held), held), 0, cap), scans.horizon(events.join(held.select("ticker").distinct(), "ticker", "left_semi"), today, horizon)


def pending_summary(news: DataFrame, events: DataFrame, today: Column, horizon: int = 14) -> DataFrame:
    """How much waits: two counts, no clustering."""
    both = pending_news(news).select(F.lit(1).alias("n"), F.lit(0).alias("e")).unionByName(scans.horizon(events, today, horizon).select(F.lit(0).alias("n"), F.lit(1).alias("e")))
    return both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("news"), F.coalesce(F.sum("e"), F.lit(0)).alias("events"), F.count("*").alias("pending"))


def brief(ticker: str, bars: DataFrame, news: DataFrame, events: DataFrame, fundamentals: DataFrame, since: Column, today: Column, thresholds: setups.Thresholds | None = None) -> dict[str, DataFrame]:
    """Everything on one ticker, from tables alone; stamps nothing."""
    own = lambda df: df.where(F.col("ticker") == ticker)
    return {"setup": setups.scan(own(bars), None, thresholds), "news": recent_stories(news, ticker, since), "events": own(events).where(F.col("event_date") >= today), "fundamentals": own(fundamentals)}


def digest(items: DataFrame, sources: DataFrame, ledger: state.Ledger, categories: list[str], threshold: float = 0.7) -> DataFrame:
    """Pending items as stories in sections, by their source's category of now; unknown sources go last."""
    named = ledger.pending(items, F.col("id")).join(sources.select("source", "category"), "source", "left").withColumn("category", F.coalesce("category", F.lit("uncategorised")))
    found = cluster.stories(named, cluster.cluster(named, "category", threshold))
    placed = found.join(named.select(F.col("id").alias("story_id"), "category"), "story_id")
    return scans.sections(placed, categories).orderBy("section", "category", "story_id")


def digest_lines(found: DataFrame) -> DataFrame:
    """A line for each story: its title and where it was seen."""
    return found.select("section", "story_id", F.concat(F.lit("• "), F.col("title"), F.lit("\n  "), F.array_join("domains", " · ")).alias("line"))


def payload(df: DataFrame) -> DataFrame:
    """Rows as JSON text."""
    return df.select(F.to_json(F.struct("*")).alias("payload"))


def macro_line() -> Column:
    return F.format_string("%s: %.2f, from %.2f (%+.2f)", F.col("series"), F.col("value"), F.col("reported"), F.col("value") - F.col("reported"))


def event_line() -> Column:
    return F.format_string("%s — %s in %d days (%s)", F.col("ticker"), F.col("kind"), F.col("days_left"), F.col("event_date").cast("string"))


def supply_line() -> Column:
    return F.format_string("%s: %d, %s %s", F.col("quarter"), F.col("total"), F.col("direction"), F.coalesce(F.format_string("%.1f%%", F.abs("pct")), F.lit("(no comparison)")))


def position_line() -> Column:
    return F.format_string("%s: %.2f at %.2f, worth %.2f (%+.1f%%)", F.col("ticker"), F.col("quantity"), F.col("avg_cost"), F.col("market_value"), F.col("unrealized_pct"))


def direction_colour(pct: Column) -> Column:
    return F.when(pct > 0, "up").when(pct < 0, "down").otherwise("neutral")
