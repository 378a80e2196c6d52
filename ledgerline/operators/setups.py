"""Base search, contraction and stage of each key's latest bar.

A base is the longest run of bars up to the latest whose depth stays within a
limit. Depth can only grow backwards, so the run ends where the running extremes
break the limit. All keys are handled in one job: bars are numbered backwards, and
the last ``max_base_len`` of each key meet in one small array.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import clamp, ordinal
from ..functions.series import Bars, with_indicators

# The weights of the score, 100 in sum.
WEIGHTS = {"contraction": 25, "bbw": 20, "proximity": 15, "expansion": 10, "touches": 10, "dryup": 10, "tightness": 10}


@dataclass(frozen=True)
class Thresholds:
    min_bars: int = 120
    lookback_percentile: int = 252
    min_base_len: int = 7
    max_base_len: int = 60
    max_base_depth: float = 0.15
    pivot_tolerance: float = 0.02
    min_pivot_touches: int = 2
    contraction_tolerance: float = 0.98
    expansion_percentile: float = 66.0
    expansion_margin: float = 1.15
    bbw_percentile: float = 20.0
    donchian_percentile: float = 25.0
    max_bbw_percentile: float = 60.0
    pivot_proximity: float = 0.03
    min_avg_dollar_volume: float = 5_000_000.0
    volume_confirm_rvol: float = 1.5
    technical_horizon_days: int = 30


def bases(bars: DataFrame, t: Thresholds | None = None) -> DataFrame:
    """ticker, base_length, base_start, base_high, base_low, base_depth of each ticker with a base."""
    t = t or Thresholds()
    back = Window.partitionBy("ticker").orderBy(F.col("day").desc())
    upto = back.rowsBetween(Window.unboundedPreceding, 0)
    near = bars.withColumn("n", F.row_number().over(back)).where(F.col("n") <= t.max_base_len)
    deep = near.withColumns({"hi": F.max("high").over(upto), "lo": F.min("low").over(upto)})
    deep = deep.withColumn("depth", F.try_divide(F.col("hi") - F.col("lo"), F.col("hi")))
    fits = deep.where((F.col("hi") > 0) & (F.col("depth") <= t.max_base_depth) & (F.col("n") >= t.min_base_len))
    longest = fits.groupBy("ticker").agg(F.max(F.struct("n", "day", "hi", "lo", "depth")).alias("b"))
    return longest.select("ticker", F.col("b.n").alias("base_length"), F.col("b.day").alias("base_start"), F.col("b.hi").alias("base_high"), F.col("b.lo").alias("base_low"), F.col("b.depth").alias("base_depth"))


def base_measures(bars: DataFrame, found: DataFrame, t: Thresholds | None = None) -> DataFrame:
    """Pivot, touches, contraction by thirds and volume dry-up of each base.

    Thirds are of ``length div 3`` bars; the middle one has the remainder. The pivot
    leaves the latest bar out, so that a breakout does not move its own level.
    """
    t = t or Thresholds()
    back = Window.partitionBy("ticker").orderBy(F.col("day").desc())
    near = bars.withColumn("n", F.row_number().over(back)).where(F.col("n") <= t.max_base_len)
    inside = near.join(found, "ticker").where(F.col("n") <= F.col("base_length"))
    size = F.floor(F.col("base_length") / 3)
    part = F.when(F.col("n") > F.col("base_length") - size, 1).when(F.col("n") <= size, 3).otherwise(2)
    inside = inside.withColumn("part", part).withColumn("pivot", F.max(F.when(F.col("n") > 1, F.col("high"))).over(Window.partitionBy("ticker")))

    def of(k: int, what: str, how) -> Column:
        return how(F.when(F.col("part") == k, F.col(what)))

    ratio = lambda k: F.try_divide(of(k, "high", F.max) - of(k, "low", F.min), of(k, "close", F.avg))
    return inside.groupBy("ticker").agg(
        F.max("pivot").alias("pivot"),
        F.sum(((F.col("n") > 1) & (F.col("high") >= F.col("pivot") * (1.0 - t.pivot_tolerance))).cast("int")).cast("int").alias("touches"),
        ratio(1).alias("ratio1"), ratio(2).alias("ratio2"), ratio(3).alias("ratio3"),
        F.try_divide(of(3, "volume", F.avg), of(1, "volume", F.avg)).alias("dryup"),
    )


def monotone(tolerance: float = 0.98) -> Column:
    r1, r2, r3 = F.col("ratio1"), F.col("ratio2"), F.col("ratio3")
    return F.coalesce((r1 > 0) & (r2 > 0) & (r2 <= r1 * tolerance) & (r3 <= r2 * tolerance), F.lit(False))


def prior_expansion(bars: DataFrame, found: DataFrame, t: Thresholds | None = None) -> DataFrame:
    """ticker, prior_expansion: whether ATR % was raised in the 20 sessions before the base (``bars`` with atr_pct)."""
    t = t or Thresholds()
    back = Window.partitionBy("ticker").orderBy(F.col("day").desc())
    placed = bars.select("ticker", "day", "atr_pct", F.row_number().over(back).alias("n"), F.count("*").over(Window.partitionBy("ticker")).alias("total"))
    after = F.col("n") - F.col("base_length")
    earlier = placed.join(found.select("ticker", "base_length"), "ticker").where((after >= 1) & (after <= t.lookback_percentile))
    per = earlier.groupBy("ticker").agg(
        F.max(F.col("total") - F.col("base_length")).alias("start"),
        F.avg(F.when(after <= 20, F.col("atr_pct"))).alias("pre"),
        F.collect_list("atr_pct").alias("history"),
        F.median("atr_pct").alias("mid"),
    )
    rank = 100.0 * F.size(F.filter("history", lambda y: y <= F.col("pre"))) / F.size("history")
    raised = (F.col("start") >= 20) & (F.size("history") >= 20) & (F.col("mid") > 0) & (F.col("pre") >= F.col("mid") * t.expansion_margin) & (rank >= t.expansion_percentile)
    return per.select("ticker", F.coalesce(raised, F.lit(False)).alias("prior_expansion"))


def score(t: Thresholds) -> Column:
    """Seven parts within 0..1, weighted; half-even rounding."""
    part = {
        "contraction": F.when(F.col("ratio1") > 0, clamp((1.0 - F.col("ratio3") / F.col("ratio1")) / 0.5)),
        "bbw": clamp(1.0 - F.col("bbw_percentile") / 100.0),
        "proximity": F.when(F.col("distance_pct") <= 0, 1.0).otherwise(clamp(1.0 - F.col("distance_pct") / 100.0 / t.pivot_proximity)),
        "expansion": F.col("prior_expansion").cast("double"),
        "touches": clamp(F.least(F.coalesce("touches", F.lit(0)), F.lit(4)) / 4.0),
        "dryup": clamp((1.0 - F.col("dryup")) / 0.5),
        "tightness": F.col("n_signals") / 4.0,
    }
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + weight * F.coalesce(part[name], F.lit(0.0))
    return F.bround(total).cast("int")


def scan(bars: DataFrame, state: DataFrame | None = None, t: Thresholds | None = None) -> DataFrame:
    """The setup of each ticker's latest bar. ``state``: ticker, stage, pivot as stored by the last scan."""
    t = t or Thresholds()
    full = with_indicators(bars)
    w = Bars()
    recent = full.withColumns({
        "nr7_recent": F.max("nr7").over(w.last(3)), "inside_recent": F.max("inside_day").over(w.last(2)),
        "n_bars": F.count("*").over(w.w), "n_back": F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("day").desc())),
    })
    last = recent.where("n_back = 1")
    found = bases(bars, t)
    joined = last.join(found, "ticker", "left").join(base_measures(bars, found, t), "ticker", "left").join(prior_expansion(full, found, t), "ticker", "left")
    before = state.select("ticker", F.col("stage").alias("previous_stage"), F.col("pivot").alias("previous_pivot")) if state is not None else None
    joined = joined.join(before, "ticker", "left") if before is not None else joined.withColumns({"previous_stage": F.lit(None).cast("string"), "previous_pivot": F.lit(None).cast("double")})
    signals = [F.col("nr7_recent"), F.col("inside_recent"), F.coalesce(F.col("bbw_percentile") <= t.bbw_percentile, F.lit(False)), F.coalesce(F.col("donchian_percentile") <= t.donchian_percentile, F.lit(False))]
    joined = joined.withColumns({
        "distance_pct": 100.0 * F.try_divide(F.col("pivot") - F.col("close"), F.col("close")),
        "n_signals": sum((s.cast("int") for s in signals[1:]), signals[0].cast("int")),
        "contraction_monotone": monotone(t.contraction_tolerance),
        "within_horizon": F.datediff("day", "base_start") <= t.technical_horizon_days,
    })
    held = (F.col("previous_stage") == "triggered") & F.col("previous_pivot").isNotNull()
    coiled = F.col("contraction_monotone") & (F.col("n_signals") > 0) & (F.col("bbw_percentile").isNull() | (F.col("bbw_percentile") <= t.max_bbw_percentile)) & (F.col("touches") >= t.min_pivot_touches) & F.col("distance_pct").between(0.0, 100.0 * t.pivot_proximity)
    stage = (
        F.when(F.col("n_bars") < t.min_bars, "none").when(F.col("adv20") < t.min_avg_dollar_volume, "none")
        .when(F.col("base_length").isNull(), F.when(F.col("atr_pct_percentile") >= t.expansion_percentile, "expansion").otherwise("none"))
        .when(F.coalesce(held, F.lit(False)), F.when(F.col("close") < F.col("previous_pivot"), "failed").otherwise("triggered"))
        .when(F.col("close") > F.col("pivot"), "triggered").when(coiled, "coiled").otherwise("basing")
    )
    reason = F.when(F.col("n_bars") < t.min_bars, "insufficient_history").when(F.col("adv20") < t.min_avg_dollar_volume, "illiquid").when(F.col("base_length").isNull() & (stage == "none"), "no_base")
    out = joined.withColumn("stage", stage).withColumn("reason", reason)
    based = F.col("stage").isin("failed", "triggered", "coiled", "basing")
    high, low = F.col("week52_high"), F.col("week52_low")
    return out.select(
        "ticker", F.col("day").alias("as_of"), "stage", "reason",
        F.when(based, score(t)).otherwise(0).alias("score"),
        "close", "pivot", "touches", "distance_pct", "base_start", "base_length", (100.0 * F.col("base_depth")).alias("base_depth_pct"),
        "ratio1", "ratio2", "ratio3", "contraction_monotone", "prior_expansion", "dryup", "within_horizon",
        F.when(F.col("stage") == "triggered", F.col("rvol") >= t.volume_confirm_rvol).alias("volume_confirmed"),
        "atr_pct", "atr_pct_percentile", "bbw", "bbw_percentile", "donchian_percentile", "nr7", "inside_day", "rvol", "adv20",
        "sma20", "sma50", "sma200", *[(100.0 * F.try_divide(F.col("close") - F.col(s), F.col(s))).alias(f"dist_{s}_pct") for s in ("sma20", "sma50", "sma200")],
        "week52_high", "week52_low", (100.0 * F.try_divide(F.col("close") - low, high - low)).alias("week52_position_pct"),
    )


def status_line() -> Column:
    """One line for a row of ``scan``."""
    name = F.concat(F.col("ticker"), F.lit(" — "))
    middle = (
        F.when(F.col("stage") == "expansion", "expanding, no base").when(F.col("stage") == "basing", F.format_string("basing %dd, %.1f%% deep", F.col("base_length"), F.col("base_depth_pct")))
        .when(F.col("stage") == "none", "no setup").otherwise(F.concat(F.col("stage"), F.lit(", score "), F.col("score").cast("string")))
    )
    more = F.concat_ws("", middle, F.concat(F.lit(", BBW "), ordinal(F.col("bbw_percentile")), F.lit(" pct")),
        F.format_string(", %.1f%% %s SMA20", F.abs("dist_sma20_pct"), F.when(F.col("dist_sma20_pct") >= 0, "above").otherwise("below")),
        F.format_string(", %.0f%% of 52w range", F.col("week52_position_pct")))
    early = F.when(F.col("reason") == "insufficient_history", "not enough history yet").when(F.col("reason") == "illiquid", F.format_string("below the liquidity floor (20d avg $%.1fM)", F.coalesce("adv20", F.lit(0.0)) / 1e6))
    return F.concat(name, F.coalesce(early, more))
