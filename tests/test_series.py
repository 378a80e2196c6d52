import math
import random
import statistics
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.series import Bars, wilder_atr, with_indicators
from ledgerline.operators import groups, portfolio, setups

B = "ticker string, day date, open double, high double, low double, close double, volume double"


def frame(spark, specs, ticker="T"):
    day, rows, before = date(2024, 1, 1), [], specs[0][0]
    for close, spread, volume in specs:
        while day.weekday() > 4:
            day += timedelta(1)
        rows.append((ticker, day, float(before), close + spread / 2, close - spread / 2, float(close), float(volume)))
        before, day = close, day + timedelta(1)
    return spark.createDataFrame(rows, B)


QUIET = [(105 + (-2.5, 0, 2.5, 0)[i % 4], 1.0, 2_000_000) for i in range(200)]
EXPANSION = [(110 + 1.55 * i, 8.0, 4_000_000) for i in range(15)]


def test_windows(spark):
    r = random.Random(1)
    closes = [100 + r.random() for _ in range(60)]
    df = frame(spark, [(c, 1 + r.random(), 100 + i) for i, c in enumerate(closes)])
    w = Bars()
    got = df.select("day", w.sma(F.col("close"), 20).alias("m"), w.stdev(F.col("close"), 20).alias("s"), w.rvol().alias("v"), w.percentile_rank(F.col("close"), 10).alias("p")).orderBy("day").collect()
    for i, g in enumerate(got):
        assert (g.m is None) == (i < 19) == (g.s is None) and (g.v is None) == (i < 20)
        if i >= 19:
            assert math.isclose(g.m, statistics.fmean(closes[i - 19 : i + 1])) and math.isclose(g.s, statistics.pstdev(closes[i - 19 : i + 1]), rel_tol=1e-9)
        history = closes[max(0, i - 9) : i + 1]
        assert math.isclose(g.p, 100 * sum(h <= closes[i] for h in history) / len(history))


def test_wilder(spark):
    r = random.Random(2)
    df = frame(spark, [(100 + r.random(), 1 + r.random(), 1) for _ in range(40)])
    rows = wilder_atr(df.withColumn("tr", Bars().true_range()), Bars()).orderBy("day").collect()
    tr, value = [x.tr for x in rows], None
    for i, x in enumerate(rows):
        value = None if i < 13 else statistics.fmean(tr[:14]) if i == 13 else (value * 13 + tr[i]) / 14
        assert x.atr is None if value is None else math.isclose(x.atr, value)


def stage(spark, specs, before=None):
    state = spark.createDataFrame([("T", *before)], "ticker string, stage string, pivot double") if before else None
    return setups.scan(frame(spark, specs), state).first()


def test_stages(spark):
    assert stage(spark, QUIET[:50]).reason == "insufficient_history"
    assert stage(spark, [(c, s, 1_000) for c, s, _ in QUIET]).reason == "illiquid"
    base = [(131 + 1.2 * math.sin(i) * (1 - i / 25), 4.0 * (1 - i / 25) + 0.4, 3_000_000 - 80_000 * i) for i in range(21)]
    coil = stage(spark, [*QUIET, *EXPANSION, *base])
    assert coil.stage in ("coiled", "basing") and coil.base_length >= 7
    broke = stage(spark, [*QUIET, *EXPANSION, *base, (140.0, 2.0, 9_000_000)])
    assert broke.stage == "triggered" and broke.volume_confirmed
    failed = stage(spark, [*QUIET, *EXPANSION, *base], ("triggered", 150.0))
    assert failed.stage == "failed"
    assert stage(spark, [*QUIET, *EXPANSION, *base], ("coiled", 150.0)).stage == coil.stage


def test_prior_expansion(spark):
    def raised(early, before):
        rows = [("T", date(2024, 1, 1) + timedelta(i), v) for i, v in enumerate([early] * 60 + [before] * 20 + [1.0] * 10)]
        df = spark.createDataFrame(rows, "ticker string, day date, atr_pct double")
        return setups.prior_expansion(df, spark.createDataFrame([("T", 10)], "ticker string, base_length int")).first().prior_expansion

    assert raised(2.0, 3.0) and not raised(2.0, 2.1) and not raised(3.0, 2.0)


def test_base_is_the_longest_in_the_band(spark):
    df = frame(spark, [(200.0, 1, 1)] * 5 + [(100.0 + i % 3, 1, 1) for i in range(20)])
    found = setups.bases(df).first()
    assert found.base_length == 20
    m = setups.base_measures(df, setups.bases(df)).first()
    assert m.pivot == 102.5 and m.touches > 2
    assert setups.bases(frame(spark, [(100.0 * 2**i, 1, 1) for i in range(10)])).count() == 0


def test_indicators_of_many_keys_do_not_mix(spark):
    both = frame(spark, QUIET[:30]).unionByName(frame(spark, [(5.0, 1.0, 9)] * 30, "U"))
    assert with_indicators(both).where("ticker = 'U' and sma20 is not null").select("sma20").distinct().first().sma20 == 5.0


def trades(spark, *rows):
    return spark.createDataFrame([(i, "T", date(2024, 1, 1) + timedelta(i), *r) for i, r in enumerate(rows)], "id long, ticker string, trade_date date, side string, quantity double, price double, fee double")


@pytest.mark.parametrize(("rows", "quantity", "realized", "avg"), [
    ([("buy", 100.0, 50.0, 0.0), ("buy", 100.0, 70.0, 0.0), ("sell", 100.0, 80.0, 0.0)], 100, 3000, 70), ([("buy", 100.0, 50.0, 0.0), ("buy", 100.0, 60.0, 0.0), ("sell", 150.0, 70.0, 0.0)], 50, 2500, 60),
    ([("buy", 100.0, 50.0, 25.0)], 100, 0, 50.25), ([("sell", 100.0, 50.0, 0.0)], -100, 0, 50), ([("buy", 100.0, 50.0, 0.0), ("sell", 150.0, 60.0, 0.0)], -50, 1000, 60),
])
def test_fifo(spark, rows, quantity, realized, avg):
    got = portfolio.fifo(trades(spark, *rows)).first()
    assert (got.quantity, got.realized, got.avg_cost) == (quantity, realized, avg)


def test_positions_are_those_of_the_fold(spark):
    import random

    r = random.Random(5)
    rows = [(i, f"T{r.randrange(4)}", date(2024, 1, 1) + timedelta(r.randrange(300)), r.choice(["buy", "sell"]), r.choice([1.5, 20.0, 300.0, 2500.0, 0.25]), float(r.randrange(1, 90)), r.choice([0.0, 1.25])) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, ticker string, trade_date date, side string, quantity double, price double, fee double")
    for got in portfolio.fifo(df).collect():
        mine = sorted((x for x in rows if x[1] == got.ticker), key=lambda x: (x[2], x[0]))
        quantity, avg, basis, realized = portfolio.match([x[3:] for x in mine])
        assert got.quantity == pytest.approx(quantity) and got.cost_basis == pytest.approx(basis) and got.realized == pytest.approx(realized) and got.avg_cost == pytest.approx(avg)


def test_wilder_in_blocks(spark):
    """Blocks of any size give the fold's values, also where a key's first bars lie in several of them."""
    df = frame(spark, QUIET).unionByName(frame(spark, QUIET[:20], "U")).unionByName(frame(spark, QUIET[:3], "V")).withColumn("tr", Bars().true_range())
    whole = {(r.ticker, r.day): r.atr for r in wilder_atr(df, Bars(), block=100_000).collect()}
    assert len(whole) == len(QUIET) + 23 and sum(v is not None for v in whole.values()) == len(QUIET) - 13 + 7
    for block in (3, 10, 256):
        for r in wilder_atr(df, Bars(), block=block).collect():
            want = whole[r.ticker, r.day]
            assert r.atr is None if want is None else math.isclose(r.atr, want, rel_tol=1e-12)


def test_wilder_of_one_long_ticker(spark):
    """A million bars of one ticker are folded in many tasks, and no task holds more than its blocks."""
    import time

    n = 1_000_000
    df = spark.range(n).select(F.lit("T").alias("ticker"), F.col("id").alias("day"), (1 + F.col("id") * 7919 % 1000 / 100).alias("tr"))
    began = time.time()
    out = wilder_atr(df, Bars(), block=4096).withColumn("p", F.spark_partition_id())
    some = {r.day: r.atr for r in out.where("day % 99991 = 5 or day = 999999").collect()}
    assert time.time() - began < 120 and out.groupBy("p").count().count() > 1
    value, tr = None, []
    for i in range(n):
        x = 1 + i * 7919 % 1000 / 100
        tr.append(x)
        value = None if i < 13 else sum(tr[:14]) / 14 if i == 13 else (value * 13 + x) / 14
        if i in some:
            assert some[i] is None if value is None else math.isclose(some[i], value, rel_tol=1e-9)
    assert n - 1 in some


def test_a_large_trade_is_one_row(spark):
    """A trade of 1e9 units meets many small ones, and costs a row."""
    rows = [(0, "T", date(2024, 1, 1), "buy", 1e9, 2.0, 0.0)] + [(k, "T", date(2024, 1, 2), "sell", 1000.0, 3.0, 0.0) for k in range(1, 500)]
    df = spark.createDataFrame(rows, "id long, ticker string, trade_date date, side string, quantity double, price double, fee double")
    got = portfolio.fifo(df).first()
    assert got.realized == pytest.approx(499_000.0) and got.quantity == 1e9 - 499_000


def test_streamed_positions(spark, tmp_path):
    """Open lots as state: three batches give what all trades at once give; a closed ticker keeps none."""
    import random

    from ledgerline.streaming import ingest

    r = random.Random(6)
    rows = [(i, f"T{r.randrange(3)}", date(2024, 1, 1) + timedelta(i // 10), r.choice(["buy", "sell"]), float(r.randrange(1, 50)), float(r.randrange(1, 90)), r.choice([None, 1.25])) for i in range(300)]
    rows += [(1000, "C", date(2024, 1, 1), "buy", 5.0, 1.0, None), (1001, "C", date(2024, 1, 25), "sell", 5.0, 2.0, None)]
    df = spark.createDataFrame(rows, "id long, ticker string, trade_date date, side string, quantity double, price double, fee double")
    for k in range(3):
        df.where(f"datediff(trade_date, date'2024-01-01') div 10 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = {}
    stream = ingest.positions(ingest.landing(spark, str(tmp_path / "in"), df.schema, files_per_batch=1))
    query = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).foreachBatch(lambda b, n: got.update({x.ticker: (n, x) for x in b.collect()})).start()
    query.awaitTermination()
    assert {n for n, _ in got.values()} == {2}
    for ticker, (_, x) in got.items():
        mine = sorted((t for t in rows if t[1] == ticker), key=lambda t: (t[2], t[0]))
        quantity, avg, basis, realized = portfolio.match([(t[3], t[4], t[5], t[6] or 0.0) for t in mine])
        assert (x.quantity, x.cost_basis, x.realized, x.avg_cost) == pytest.approx((quantity, basis, realized, avg))
    assert got["C"][1].open_lots == 0


def test_sector(spark):
    members = spark.createDataFrame([("s", t) for t in "abcd"] + [("few", "x"), ("few", "y")], "sector string, ticker string")
    returns = spark.createDataFrame([("a", 10.0), ("b", 2.0), ("c", 1.0), ("x", 1.0)], "ticker string, ret double")
    view = {r.sector: r for r in groups.sector_view(members, returns).collect()}
    assert view["s"].median_return == 2.0 and view["s"].leaders == "a" and view["s"].missing == "d" and view["s"].breadth_up == 3
    assert view["few"].median_return is None and view["few"].cohesion == "unknown"
    carried = groups.standing(groups.sector_view(members, returns), members, returns)
    assert {r.ticker: r.position for r in carried.collect()} == {"a": "leading", "b": "in_line", "c": "in_line"}
