"""Spending rollups: totals, shares, calendar groups, folded tails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import month_of
from ..functions.numbers import money


def spending_filter(month: str | None = None, member: str | None = None, year: str | None = None) -> Column:
    """Month and year as ranges of ``ts`` (they reach the scan), member in any case."""
    found = F.lit(True)
    if month:
        first = F.to_timestamp_ntz(F.lit(f"{month}-01 00:00:00"))
        found = found & (F.col("ts") >= first) & (F.col("ts") < F.add_months(first.cast("date"), 1).cast("timestamp_ntz"))
    if year:
        found = found & (F.col("ts") >= F.to_timestamp_ntz(F.lit(f"{year}-01-01 00:00:00"))) & (F.col("ts") < F.to_timestamp_ntz(F.lit(f"{int(year) + 1}-01-01 00:00:00")))
    if member:
        found = found & (F.lower("member") == member.lower())
    return found


def totals_by(expenses: DataFrame, *keys: str) -> DataFrame:
    """total and n of each group; without keys one row, zero where empty."""
    return expenses.groupBy(*keys).agg(F.coalesce(F.sum(money(F.col("amount"))), F.lit(0)).cast("double").alias("total"), F.count("*").alias("n"))


def category_summary(expenses: DataFrame) -> DataFrame:
    """total, n and share of each category; the share from unrounded sums."""
    by = totals_by(expenses, "category")
    # One row a category: the grand total comes from them, not from the expenses again.
    whole = F.sum(money(F.col("total"))).over(Window.partitionBy()).cast("double")
    return by.select("category", "total", "n", (100.0 * F.try_divide(F.col("total"), whole)).alias("pct"))


def top_days(expenses: DataFrame, limit: int = 5) -> DataFrame:
    """The most costly days, later first among equals, each with its categories."""
    parts = totals_by(expenses.withColumn("day", F.col("ts").cast("date")), "day", "category")
    days = parts.groupBy("day").agg(
        F.sum(money(F.col("total"))).cast("double").alias("total"), F.sum("n").alias("n"),
        F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "total"))))).alias("categories"),
    )
    return days.orderBy(F.desc("total"), F.desc("day")).limit(limit)


def months(expenses: DataFrame) -> DataFrame:
    return totals_by(expenses.withColumn("month", month_of(F.col("ts"))), "month")


def months_by_category(expenses: DataFrame) -> DataFrame:
    """month, category, total, and the month's total as the sum of its parts as shown (two decimals)."""
    parts = totals_by(expenses.withColumn("month", month_of(F.col("ts"))), "month", "category")
    whole = F.sum(money(F.col("total"))).over(Window.partitionBy("month"))
    return parts.select("month", "category", "total", "n", whole.cast("double").alias("month_total"))


def fold_tail(by_category: DataFrame, keep: int = 7, other: str = "Other") -> DataFrame:
    """The largest categories, the rest as one; a single one over ``keep`` is not folded."""
    order = Window.orderBy(F.desc("total"), "category")  # a row for each category
    placed = by_category.withColumns({"rank": F.row_number().over(order), "of": F.count("*").over(Window.partitionBy())})
    shown = F.when((F.col("rank") <= keep) | (F.col("of") <= keep + 1), F.col("category")).otherwise(other)
    return placed.groupBy(shown.alias("slice")).agg(F.sum(money(F.col("total"))).cast("double").alias("total"), F.sum("n").alias("n"))


def unmapped(expenses: DataFrame, uncategorized: str = "Uncategorized") -> DataFrame:
    """Keywords without a category: how often, how much, and their first description."""
    return expenses.where(F.col("category") == uncategorized).groupBy("keyword").agg(F.count("*").alias("n"), F.sum(money(F.col("amount"))).cast("double").alias("total"), F.min("description").alias("example"))


def headings(by_category: DataFrame, shown: int = 3) -> DataFrame:
    """Category ranks for a table with few columns; the others go under Other."""
    rank = F.dense_rank().over(Window.orderBy(F.desc("total"), "category"))
    return by_category.select("category", "total", rank.alias("rank"), F.when(rank <= shown, F.col("category")).otherwise("Other").alias("heading"))


def stacked(by_month: DataFrame, by_category: DataFrame) -> DataFrame:
    """Bars of a month stacked by the year's rank of their category."""
    ranks = by_category.select("category", F.row_number().over(Window.orderBy(F.desc("total"), "category")).alias("rank"))
    w = Window.partitionBy("month").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    return by_month.join(ranks, "category").select("month", "category", "total", "rank", F.coalesce(F.sum(money(F.col("total"))).over(w), F.lit(0)).cast("double").alias("bottom"))


def latest_expenses(expenses: DataFrame, limit: int = 20) -> DataFrame:
    return expenses.orderBy(F.desc("ts"), F.desc("id")).limit(limit)


def histogram(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order; ties must be broken by it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def latest_n(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The newest n rows of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def thinned_ticks(df: DataFrame, order: str, most: int = 14) -> DataFrame:
    """Every ceil(n / most)-th row, counted back from the last."""
    back = F.row_number().over(Window.orderBy(F.desc(order)))
    n = F.count("*").over(Window.partitionBy())
    return df.withColumns({"__b": back, "__s": F.ceil(n / most)}).where(F.pmod(F.col("__b") - 1, F.col("__s")) == 0).drop("__b", "__s")


def axis_limits(df: DataFrame, value: str) -> DataFrame:
    """A tenth of the span on either side, a twentieth of a flat value, not under zero."""
    lo, hi = F.min(value), F.max(value)
    pad = F.when(hi > lo, (hi - lo) * 0.1).otherwise(F.abs(hi) * 0.05)
    return df.agg(F.greatest(F.lit(0.0), lo - pad).alias("low"), (hi + pad).alias("high"))


def latest_value(df: DataFrame, value: str, order: str) -> DataFrame:
    """The value of the newest row, as with the currency of the last expense."""
    return df.agg(F.max_by(value, order).alias(value))
