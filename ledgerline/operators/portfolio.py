"""Positions: lots matched first in, first out, shorts and flips included; ``match`` is the plain fold that tests hold them against."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TINY = 1e-9


def match(trades: list[tuple[str, float, float, float]]) -> tuple[float, float, float, float]:
    """(quantity, average cost, cost basis, realized) of (side, quantity, price, fee) in order.

    A fee raises the price paid and lowers the price got. What a trade does not
    close of the other side opens a lot of its own.
    """
    lots: deque[list[float]] = deque()
    realized = meet(lots, trades)
    held = sum(q for q, _ in lots)
    basis = sum(q * p for q, p in lots)
    return held, basis / held if held else 0.0, basis, realized


def meet(lots: deque[list[float]], trades: Iterable[tuple[str, float, float, float]]) -> float:
    """What trades realize against open ``lots`` (signed quantity, price each), which they close and open."""
    realized = 0.0
    for side, quantity, price, fee in trades:
        sign = 1.0 if side == "buy" else -1.0
        each = price + sign * (fee / quantity if quantity else 0.0)
        left = quantity
        while left and lots and lots[0][0] * sign < 0:
            closed = min(abs(lots[0][0]), left)
            realized += closed * (lots[0][1] - each) * sign
            lots[0][0] += closed * sign
            left -= closed
            if abs(lots[0][0]) < TINY:
                lots.popleft()
        if left:
            lots.append([left * sign, each])
    return realized


#: Quantities are added exactly, whatever the order of tasks.
_EXACT = "decimal(38,9)"


def _stretches(trades: DataFrame) -> DataFrame:
    """Each trade as a stretch lo..hi of its ticker's cumulative bought or sold quantity, with its price ``each``, fee included."""
    w = Window.partitionBy("ticker", "side").orderBy("trade_date", "id").rowsBetween(Window.unboundedPreceding, 0)
    q = F.col("quantity").cast(_EXACT)
    fee = F.coalesce(F.try_divide(F.col("fee"), F.col("quantity")), F.lit(0.0))
    each = F.col("price") + F.when(F.col("side") == "buy", fee).otherwise(-fee)
    return trades.select("ticker", "side", each.alias("each"), F.sum(q).over(w).cast(_EXACT).alias("hi"), q.alias("q")).withColumn("lo", (F.col("hi") - F.col("q")).cast(_EXACT)).drop("q")


def realized(trades: DataFrame) -> DataFrame:
    """Realized profit of each ticker with any: the k-th unit bought meets the k-th unit sold.

    That is what first-in-first-out matching does, whichever of the two came first, so
    shorts and flips need no fold. The ends of both sides' stretches cut the units into
    segments; within one, the price of each side is that of the next end of its own, at
    or above the segment's. So one window over a ticker's trades, from the last unit
    down, pairs the sides: a row a trade, whatever its quantity, and no join.
    """
    down = Window.partitionBy("ticker").orderBy(F.desc("hi"), "side")
    upto = down.rowsBetween(Window.unboundedPreceding, 0)
    price = lambda side: F.last(F.when((F.col("side") == "buy") == (side == "buy"), F.col("each")), True).over(upto)
    below = F.coalesce(F.lead("hi").over(down), F.lit(0).cast(_EXACT))
    cut = _stretches(trades).where("lo < hi").select("ticker", price("buy").alias("cost"), price("sell").alias("got"), (F.col("hi") - below).cast("double").alias("closed"))
    return cut.where("cost is not null and got is not null").groupBy("ticker").agg(F.sum(F.col("closed") * (F.col("got") - F.col("cost"))).alias("realized"))


def fifo(trades: DataFrame) -> DataFrame:
    """Net position of each ticker: what one side has over the other's total is what is held, at its own prices."""
    run = _stretches(trades)
    top = lambda side: F.coalesce(F.max(F.when((F.col("side") == "buy") == (side == "buy"), F.col("hi"))), F.lit(0).cast(_EXACT))
    totals = run.groupBy("ticker").agg(top("buy").alias("bought"), top("sell").alias("sold"))
    buys = F.col("side") == "buy"
    left = F.greatest(F.col("hi") - F.greatest(F.col("lo"), F.when(buys, F.col("sold")).otherwise(F.col("bought"))), F.lit(0).cast(_EXACT)).cast("double")
    lots = run.join(totals, "ticker").groupBy("ticker").agg(F.max(F.col("bought") - F.col("sold")).cast("double").alias("quantity"), F.sum(F.when(buys, left).otherwise(-left) * F.col("each")).alias("cost_basis"))
    held = lots.join(realized(trades), "ticker", "left").withColumn("avg_cost", F.when(F.col("quantity") != 0, F.col("cost_basis") / F.col("quantity")).otherwise(0.0))
    return held.select("ticker", "quantity", "avg_cost", "cost_basis", F.coalesce("realized", F.lit(0.0)).alias("realized"))


def net_quantities(trades: DataFrame) -> DataFrame:
    """Signed quantity of each ticker and its first trade."""
    signed = F.when(F.col("side") == "buy", F.col("quantity")).otherwise(-F.col("quantity"))
    return trades.groupBy("ticker").agg(F.sum(signed.cast("decimal(38,6)")).cast("double").alias("quantity"), F.min(F.struct("trade_date", "id")).alias("first"))


def open_tickers(trades: DataFrame) -> DataFrame:
    return net_quantities(trades).where(F.abs("quantity") > TINY).orderBy("first").select("ticker", "quantity")


def priced(holdings: DataFrame, last_close: DataFrame) -> DataFrame:
    """Holdings with market value and unrealized profit where a close is known."""
    joined = holdings.join(last_close, "ticker", "left")
    value = F.when(F.col("quantity") != 0, F.col("quantity") * F.col("last_close"))
    return joined.withColumn("market_value", value).withColumn("unrealized", value - F.col("cost_basis")).withColumn("unrealized_pct", 100.0 * F.try_divide(value - F.col("cost_basis"), F.abs("cost_basis")))
