"""Indicators over daily bars, as window columns that are null until their window is full."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Bars:
    """Windows over one key's bars in day order; every indicator shares their partitioning and sort."""

    def __init__(self, key: str = "ticker", day: str = "day"):
        self.key, self.day = key, day

    @property
    def w(self):
        return Window.partitionBy(self.key).orderBy(self.day)

    def last(self, n: int):
        return self.w.rowsBetween(-(n - 1), 0)

    def full(self, value: Column, x: Column, n: int) -> Column:
        return F.when(F.count(x).over(self.last(n)) == n, value)

    def sma(self, x: Column, n: int) -> Column:
        return self.full(F.avg(x).over(self.last(n)), x, n)

    def stdev(self, x: Column, n: int) -> Column:
        return self.full(F.stddev_pop(x).over(self.last(n)), x, n)

    def true_range(self) -> Column:
        h, lo, before = F.col("high"), F.col("low"), F.lag("close").over(self.w)
        return F.greatest(h - lo, F.abs(h - before), F.abs(lo - before))

    def bollinger_width(self, n: int = 20, k: float = 2.0) -> Column:
        c = F.col("close")
        return F.try_divide(2 * k * self.stdev(c, n), self.sma(c, n))

    def donchian_width(self, n: int = 20) -> Column:
        spread = F.max("high").over(self.last(n)) - F.min("low").over(self.last(n))
        return self.full(F.try_divide(spread, F.col("close")), F.col("close"), n)

    def percentile_rank(self, x: Column, lookback: int = 252) -> Column:
        """Share (of 100) of the defined values up to the current one, itself included, that are not above it."""
        seen = F.collect_list(x).over(self.last(lookback))
        return F.when(x.isNotNull(), F.when(F.size(seen) == 0, 50.0).otherwise(100.0 * F.size(F.filter(seen, lambda y: y <= x)) / F.size(seen)))

    def nr7(self) -> Column:
        spread = F.col("high") - F.col("low")
        return F.coalesce(self.full(spread <= F.min(spread).over(self.last(7)), spread, 7), F.lit(False))

    def inside_day(self) -> Column:
        return F.coalesce((F.col("high") <= F.lag("high").over(self.w)) & (F.col("low") >= F.lag("low").over(self.w)), F.lit(False))

    def rvol(self, n: int = 20) -> Column:
        before = self.w.rowsBetween(-n, -1)
        return F.when(F.count("volume").over(before) == n, F.try_divide(F.col("volume"), F.avg("volume").over(before)))

    def average_volume(self, n: int) -> Column:
        return self.sma(F.col("volume"), n)

    def dollar_volume(self, n: int) -> Column:
        return self.sma(F.col("close") * F.col("volume"), n)

    def week52(self) -> tuple[Column, Column]:
        return F.max("high").over(self.last(252)), F.min("low").over(self.last(252))

    def horizon_return(self, sessions: int) -> Column:
        """Percent change over the last sessions, all of a shorter history."""
        start = F.first("close").over(self.w.rowsBetween(-sessions, 0))
        return 100.0 * F.try_divide(F.col("close") - start, start)


def _scan(items: Column, start: Column, step, kind: str, block: int = 256) -> Column:
    """The states after each of ``items``, folded in blocks: no array longer than a block is copied at a step."""

    def within(acc: Column, b: Column) -> Column:
        first = F.struct(acc["at"].alias("at"), F.expr(f"cast(array() as array<{kind}>)").alias("out"))
        add = lambda a, x: F.transform(F.array(step(a["at"], x)), lambda r: F.struct(r.alias("at"), F.concat(a["out"], F.array(r)).alias("out")))[0]
        done = F.array(F.aggregate(F.slice(items, b * block + 1, F.lit(block)), first, add))
        return F.transform(done, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["outs"], F.array(r["out"])).alias("outs")))[0]

    blocks = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(items) / block).cast("int") - 1, F.lit(0)))
    return F.flatten(F.aggregate(blocks, F.struct(start.alias("at"), F.expr(f"cast(array() as array<array<{kind}>>)").alias("outs")), within)["outs"])


def wilder_atr(df: DataFrame, bars: Bars, n: int = 14, block: int = 256) -> DataFrame:
    """``df`` (with ``tr``) plus ``atr``: the mean of the first n ranges, then (before * (n - 1) + tr) / n.

    A step is x -> a x + b with one a for all, and such steps compose. So a key's bars
    are cut into blocks by their day (``block`` days, hours of time stamps, or units of a
    number), in as many tasks as there are; each block tells what it does to any x; a
    scan over the blocks' few numbers gives each the state that it starts from; and each
    is folded again from there. A key's bars are never together; its blocks' sums are.
    """
    kind, day = dict(df.dtypes)[bars.day], F.col(bars.day)
    place = F.datediff(day, F.lit("1970-01-01").cast("date")) if kind == "date" else F.floor(F.unix_micros(day.cast("timestamp")) / 3_600_000_000) if kind.startswith("timestamp") else day
    rest = [c for c in df.columns if c not in (bars.key, bars.day, "tr")]
    a = (n - 1) / n
    cut = df.withColumn("__block", F.floor(place / block)).groupBy(bars.key, "__block").agg(F.sort_array(F.collect_list(F.struct(bars.day, "tr", *rest))).alias("s"))
    effect = lambda rows: F.aggregate(rows, F.lit(0.0), lambda v, x: (v * (n - 1) + x["tr"]) / n)
    # The first n bars of a key are summed, not stepped: a block that may hold some keeps them.
    told = cut.select(bars.key, "__block", F.size("s").alias("size"), effect(F.col("s")).alias("b"), F.transform(F.slice("s", 1, n), lambda x: x["tr"]).alias("head"))
    listed = told.groupBy(bars.key).agg(F.sort_array(F.collect_list(F.struct("__block", "size", "b", "head"))).alias("bs"))

    def whole(at: Column, x: Column) -> Column:
        """The state (bars so far, value) behind a block: the sum of the ranges up to n bars, then the average."""
        before, size = at["i"], x["size"]
        m = F.greatest(F.lit(n) - before, F.lit(0))  # bars of the block that the first mean takes
        head = F.aggregate(F.slice(x["head"], F.lit(1), m), at["v"], lambda v, t: v + t)
        stepped = F.aggregate(F.slice(x["head"], F.lit(1), m), F.lit(0.0), lambda v, t: (v * (n - 1) + t) / n)
        left = F.pow(F.lit(a), (size - m).cast("double"))
        seeded = left * (head / n) + (x["b"] - left * stepped)
        on = F.pow(F.lit(a), size.cast("double")) * at["v"] + x["b"]
        return F.struct((before + size).alias("i"), F.when(m == 0, on).when(size >= m, seeded).otherwise(head).alias("v"))

    first = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("v"))
    behind = listed.select(bars.key, "bs", _scan(F.col("bs"), first, whole, "struct<i:int,v:double>", 256).alias("ends"))
    starts = behind.select(bars.key, F.explode(F.transform("bs", lambda x, k: F.struct(x["__block"].alias("block"), F.when(k == 0, first).otherwise(F.get("ends", k - 1)).alias("at")))).alias("z"))
    starts = starts.select(F.col(bars.key).alias("__key"), F.col("z.block").alias("__at"), F.col("z.at").alias("__start"))

    def step(at: Column, x: Column) -> Column:
        i = at["i"] + 1
        v = F.when(i < n, at["v"] + x["tr"]).when(i == n, (at["v"] + x["tr"]) / n).otherwise((at["v"] * (n - 1) + x["tr"]) / n)
        return F.struct(i.alias("i"), v.alias("v"))

    met = cut.join(starts, cut[bars.key].eqNullSafe(F.col("__key")) & (cut["__block"] == F.col("__at")))
    folded = met.select(bars.key, "s", F.transform(_scan(F.col("s"), F.col("__start"), step, "struct<i:int,v:double>"), lambda r: F.when(r["i"] >= n, r["v"])).alias("atr"))
    each = folded.select(bars.key, F.explode(F.arrays_zip("s", "atr")).alias("z"))
    return each.select(*[F.col(c) if c == bars.key else F.col(f"z.s.{c}").alias(c) for c in df.columns], F.col("z.atr").alias("atr"))


def with_indicators(df: DataFrame, bars: Bars | None = None) -> DataFrame:
    """Bars (key, day, open, high, low, close, volume) with every indicator."""
    bars = bars or Bars()
    tr = df.withColumn("tr", bars.true_range())
    out = wilder_atr(tr, bars)
    high52, low52 = bars.week52()
    out = out.withColumns({
        "atr_pct": 100.0 * F.try_divide(F.col("atr"), F.col("close")),
        "bbw": bars.bollinger_width(), "donchian": bars.donchian_width(),
        "sma20": bars.sma(F.col("close"), 20), "sma50": bars.sma(F.col("close"), 50), "sma200": bars.sma(F.col("close"), 200),
        "nr7": bars.nr7(), "inside_day": bars.inside_day(), "rvol": bars.rvol(),
        "adv20": bars.dollar_volume(20), "week52_high": high52, "week52_low": low52,
    })
    return out.withColumns({f"{c}_percentile": bars.percentile_rank(F.col(c)) for c in ("atr_pct", "bbw", "donchian")})
