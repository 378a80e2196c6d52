"""As-of and calendar-exact comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import quarter_label
from ..functions.numbers import direction


def as_of(df: DataFrame, keys: list[str], time: str, value: str, at: str) -> DataFrame:
    """Each key's newest row at or before a date, however far back. One aggregation, no sort."""
    upto = df.where(F.col(time) <= F.lit(at).cast("date"))
    return upto.groupBy(*keys).agg(F.max_by(value, time).alias(value), F.max(time).alias(time))


def movement(df: DataFrame, keys: list[str], time: str, value: str, at: str, days: int = 7) -> DataFrame:
    """The as-of value of each key now and ``days`` ago, with delta and percent.

    Both sides come from one aggregation: two conditional maxima instead of two scans
    and a join.
    """
    now = F.lit(at).cast("date")
    then = F.date_sub(now, days)
    upto = df.where(F.col(time) <= now)
    both = upto.groupBy(*keys).agg(
        F.max_by(value, time).alias("current"), F.max(time).alias("current_date"),
        F.max_by(F.when(F.col(time) <= then, F.col(value)), F.when(F.col(time) <= then, F.col(time))).alias("prior"),
        F.max(F.when(F.col(time) <= then, F.col(time))).alias("prior_date"),
    )
    delta = F.col("current") - F.col("prior")
    return both.withColumn("delta", delta).withColumn("pct", 100.0 * F.try_divide(delta, F.col("prior")))


def movers(moved: DataFrame, limit: int = 5, drops: bool = True) -> DataFrame:
    """The largest drops or rises; keys without an earlier value have none."""
    side = moved.where(F.col("delta") < 0 if drops else F.col("delta") > 0)
    return side.orderBy(F.col("delta").asc_nulls_last() if drops else F.col("delta").desc_nulls_last()).limit(limit)


def nearest(trend: DataFrame, keys: list[str], time: str, value: str, at: str, days: int = 7, tolerance: int = 3) -> DataFrame:
    """Each key's value at a date against that nearest to ``days`` before, within a tolerance; the earlier of equals."""
    now = F.lit(at).cast("date")
    then = F.date_sub(now, days)
    off = F.abs(F.datediff(F.col(time), then))
    near = F.when((off <= tolerance) & (F.col(time) < now), F.struct(off, F.col(time), F.col(value).alias("v")))
    out = trend.where(F.col(time).between(F.date_sub(then, tolerance), now)).groupBy(*keys).agg(F.max(F.when(F.col(time) == now, F.col(value))).alias("current"), F.min(near).alias("m"))
    delta = F.col("current") - F.col("m.v")
    return out.where("current is not null").select(*keys, "current", F.col("m.v").alias("prior"), F.col(f"m.{time}").alias("prior_date"), delta.alias("delta"), (100.0 * F.try_divide(delta, F.col("m.v"))).alias("pct"))


def quarter_on_quarter(quarters: DataFrame, value: str = "total") -> DataFrame:
    """Each quarter against the calendar quarter before it; a gap gives no change, never the next older one."""
    before = quarters.select((F.col("q_index") + 1).alias("q_index"), F.col(value).alias("before"))
    joined = quarters.join(before, "q_index", "left")
    delta = F.col(value) - F.col("before")
    return joined.withColumns({
        "quarter": quarter_label(F.col("q_index")), "delta": delta,
        "pct": F.when(F.col("before") != 0, 100.0 * delta / F.col("before")),
        "basis": F.when(F.col("before").isNull(), "unavailable").otherwise("previous quarter"), "direction": direction(delta),
    })


def quarter_table(quarters: DataFrame, n: int, end: int | None = None, value: str = "total") -> DataFrame:
    """The newest n quarters up to ``end``, their changes from the whole history."""
    table = quarter_on_quarter(quarters, value)
    if end is not None:
        table = table.where(F.col("q_index") <= end)
    return table.orderBy(F.desc("q_index")).limit(n)


def islands(words: DataFrame, page: list[str], centre: str, tolerance: float = 8.0, text: str = "text", x: str = "x0") -> DataFrame:
    """Visual rows: items whose centres follow each other within a tolerance, their texts from left to right."""
    w = Window.partitionBy(*page).orderBy(centre, x)
    starts = F.when(F.col(centre) - F.lag(centre).over(w) > tolerance, 1).otherwise(0)
    numbered = words.withColumn("__s", starts).withColumn("row", F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    line = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(x, text))), lambda s: s[text]), " ")
    return numbered.groupBy(*page, "row").agg(line.alias("line"), F.count("*").alias("n"))


def same_day_spread(series: DataFrame, low: str, high: str) -> DataFrame:
    """The newest readings of two series, only where both are of one date."""
    newest = series.where(F.col("series").isin(low, high)).groupBy("series").agg(F.max("as_of").alias("as_of"), F.max_by("value", "as_of").alias("value"))
    a, b = newest.where(F.col("series") == low), newest.where(F.col("series") == high)
    joined = a.select("as_of", F.col("value").alias("low_value")).join(b.select("as_of", F.col("value").alias("high_value")), "as_of")
    spread = F.col("high_value") - F.col("low_value")
    return joined.select("as_of", "low_value", "high_value", spread.alias("spread"), (spread < 0).alias("inverted"))


def changed_since_reported(readings: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Series whose newest value is at least ``move`` from that last reported.

    ``readings``: series, as_of, value, notified_at; ``thresholds``: series, move. A
    series never reported is a starting point, not a change; drift adds up, for the
    comparison is with the report, not with the reading before.
    """
    state = readings.groupBy("series").agg(
        F.max("as_of").alias("as_of"), F.max_by("value", "as_of").alias("value"),
        F.max_by(F.when(F.col("notified_at").isNotNull(), F.col("value")), F.when(F.col("notified_at").isNotNull(), F.col("as_of"))).alias("reported"),
    )
    joined = state.join(thresholds, "series")
    return joined.where(F.col("reported").isNotNull() & (F.abs(F.col("value") - F.col("reported")) + 1e-12 >= F.col("move")))
