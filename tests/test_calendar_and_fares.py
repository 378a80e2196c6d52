from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import dates
from ledgerline.operators import asof, fares


def quarters(spark, rows):
    return spark.createDataFrame([(k, v) for k, v in rows], "quarter string, total long").withColumn("q_index", dates.parse_quarter(F.col("quarter")))


def test_quarter_on_quarter_refuses_a_gap(spark):
    got = {r.quarter: r for r in asof.quarter_on_quarter(quarters(spark, [("2025/Dec", 104000), ("2025/Jun", 101000)])).collect()}
    assert got["2025/Dec"].pct is None and got["2025/Dec"].basis == "unavailable" and got["2025/Dec"].direction == "none"


def test_change_is_computed_outside_the_window(spark):
    rows = [("2026/Jun", 96000), ("2026/Mar", 101000), ("2025/Dec", 104000)]
    got = asof.quarter_table(quarters(spark, rows), 2).collect()
    assert [r.quarter for r in got] == ["2026/Jun", "2026/Mar"] and got[1].delta == -3000


def test_quarter_labels(spark):
    df = spark.createDataFrame([("2026/Jun",), ("2026/Apr",), ("x",), (None,)], "q string").select("q", dates.parse_quarter(F.col("q")).alias("i"))
    got = {r.q: r.i for r in df.collect()}
    assert got["2026/Jun"] == 2026 * 4 + 2 and got["2026/Apr"] is None
    row = df.where("q = '2026/Jun'").select(dates.quarter_label(F.col("i")).alias("l"), dates.quarter_end(F.col("i")).alias("e"), dates.quarter_label(F.col("i") - 2).alias("p")).first()
    assert row.l == "2026/Jun" and row.e == date(2026, 6, 30) and row.p == "2025/Dec"


@pytest.mark.parametrize(("clock", "ok"), [("2026-08-05 14:30:00", True), ("2026-08-05 14:30:01", False), ("2026-08-05 11:29:59", False), ("2026-08-08 12:00:00", False)])
def test_time_window(spark, clock, ok):
    df = spark.createDataFrame([(datetime.fromisoformat(clock),)], "t timestamp_ntz")
    assert df.select(dates.in_window(F.col("t"), [0, 1, 2, 3, 4], 690, 870)).first()[0] == ok


@pytest.mark.parametrize(("hour", "ok"), [(23, True), (1, True), (12, False)])
def test_window_past_midnight(spark, hour, ok):
    df = spark.createDataFrame([(datetime(2026, 8, 5, hour, 30),)], "t timestamp_ntz")
    assert df.select(dates.in_window(F.col("t"), list(range(7)), 1320, 120)).first()[0] == ok


def test_local_and_utc(spark):
    df = spark.createDataFrame([("2026-07-31T17:10:00Z",), ("1785517800",), ("2026-08-01 01:10:00",), ("nonsense",)], "v string")
    got = [r.p for r in df.select(dates.parse_local(F.col("v"), "Asia/Hong_Kong").alias("p")).collect()]
    assert got[0].local == got[2].local == datetime(2026, 8, 1, 1, 10) and got[0].utc == datetime(2026, 7, 31, 17, 10) == got[2].utc
    assert got[1].utc == datetime(2026, 7, 31, 17, 10) and got[3].local is None


def test_movement(spark):
    rows = [("a", date(2026, 11, d), float(100 + d)) for d in (1, 5, 8)] + [("b", date(2026, 11, 8), 50.0)]
    df = spark.createDataFrame(rows, "k string, run_date date, price double")
    got = {r.k: r for r in asof.movement(df, ["k"], "run_date", "price", "2026-11-08").collect()}
    assert got["a"].prior == 101.0 and got["a"].delta == 7.0 and got["b"].prior is None
    near = {r.k: r for r in asof.nearest(df, ["k"], "run_date", "price", "2026-11-08").collect()}
    assert near["a"].prior_date == date(2026, 11, 1) and near["b"].prior is None
    tie = spark.createDataFrame([("a", date(2026, 11, d), float(d)) for d in (1, 3, 9)], "k string, run_date date, price double")
    assert asof.nearest(tie, ["k"], "run_date", "price", "2026-11-09").first().prior == 1.0


def test_reported_change(spark):
    def moved(*rows):
        df = spark.createDataFrame([("s", date(2026, 1, d), v, datetime(2026, 1, 1) if n else None) for d, v, n in rows], "series string, as_of date, value double, notified_at timestamp_ntz")
        return asof.changed_since_reported(df, spark.createDataFrame([("s", 0.10)], "series string, move double")).count()

    assert moved((1, 4.50, True), (2, 4.54, False), (3, 4.58, False), (4, 4.62, False)) == 1
    assert moved((1, 4.60, True), (2, 4.65, False)) == 0 and moved((1, 4.6, False), (2, 9.9, False)) == 0


LONG = "From 6542 Hong Kong dollars round trip total. Nonstop flight with Cathay Pacific. Leaves Hong Kong International Airport at 6:25 PM on Friday, December 18 and arrives at Dubai International Airport at 12:05 AM on Saturday, December 19. Total duration 9 hr 40 min."


def test_labels(spark):
    labels = [LONG, "9:35 AM HKG to DXB, 3h 45m, Cathay Pacific. $6,542 round trip", "From 900 euros round trip total. 1 stop flight with Emirates and flydubai. Leaves London at 11:00 PM on Thursday, December 31 and arrives at Paris at 1:00 AM on Friday, January 1.", "Select flight", None]
    got = [r.p for r in spark.createDataFrame([(t,) for t in labels], "t string").select(fares.parse_label(F.col("t")).alias("p")).collect()]
    assert (got[0].origin, got[0].dest, got[0].depart_time, got[0].arrive_time, got[0].day_shift, got[0].duration_min) == ("HKG", "DXB", "18:25", "00:05", 1, 580)
    assert (got[0].price, got[0].currency, got[0].airline, got[0].stops) == (6542.0, "HKD", "Cathay Pacific", 0)
    assert (got[1].origin, got[1].depart_time, got[1].duration_min, got[1].price, got[1].airline) == ("HKG", "09:35", 225, 6542.0, "Cathay Pacific")
    assert (got[2].stops, got[2].airline, got[2].day_shift, got[2].duration_min, got[2].currency) == (1, "Emirates", 1, 120, "EUR")
    assert got[3] is None and got[4] is None
    assert [len(g.legs) for g in got[:3]] == [1, 1, 1] and [g.round_trip for g in got[:3]] == [True] * 3


def test_labels_of_several_legs(spark):
    back = " Leaves Dubai International Airport at 9:00 AM on Saturday, December 26 and arrives at Hong Kong International Airport at 8:45 PM on Saturday, December 26."
    labels = [
        "10:00 AM HKG to DXB, 8h, Emirates EK 381, nonstop. 5:00 PM DXB to HKG, 7h 40m, 1 stop, CX 746. $5,000",
        LONG + back,
        "5:00 PM DXB to HKG, 8h, Emirates. Price: HKD 900",
        "Leaves HKG on time",
    ]
    df = spark.createDataFrame([(t,) for t in labels], "t string").select(fares.parse_label(F.col("t")).alias("option"))
    got = [r.option for r in df.collect()]
    first, second = got[0].legs
    assert (first.airline, first.flight_no, first.duration_min, first.stops) == ("Emirates", "EK381", 480, 0)
    assert (second.origin, second.depart_time, second.airline, second.flight_no, second.duration_min, second.stops) == ("DXB", "17:00", "CX", "CX746", 460, 1)
    assert got[0].round_trip and got[0].price == 5000.0 and got[0].currency is None
    assert [(x.origin, x.dest, x.duration_min) for x in got[1].legs] == [("HKG", "DXB", 580), ("DXB", "HKG", 580)]
    assert (got[2].origin, got[2].round_trip, got[2].price, got[2].currency) == ("DXB", False, 900.0, "HKD") and got[3] is None
    hkg, dxb = F.lit("HKG"), F.lit("DXB")
    assert fares.outbound(df, hkg, dxb).count() == 2 and fares.inbound(df, hkg, dxb).count() == 3


def test_cells_count_the_bucket(spark):
    rows = [(1, "X", "09-12", 0, 500.0, "p"), (2, "X", "09-12", 1, 400.0, "q"), (3, "X", "09-12", 0, 450.0, "r"), (4, "X", "12-15", 0, None, "s")]
    df = spark.createDataFrame(rows, "id long, airline string, ret_bucket string, ret_stops int, price double, ret_airline string")
    got = {r.ret_stops: r for r in fares.cells(df, ["airline"]).collect()}
    assert got[0].min_price == 450.0 and got[0].return_airline == "r" and got[0].n_itineraries == got[1].n_itineraries == 3


def test_islands(spark):
    words = [("b", 20.0, 100.0), ("a", 10.0, 102.0), ("c", 5.0, 115.0), ("d", 6.0, 122.0)]
    df = spark.createDataFrame([(1, *w) for w in words], "page int, text string, x0 double, centre double")
    assert sorted(r.line for r in asof.islands(df, ["page"], "centre").collect()) == ["a b", "c d"]


def test_directions_parse_a_label_once(spark):
    label = "Leaves Hong Kong International Airport at 8:00 AM on Monday, May 4 and arrives at Dubai Airport at 1:00 PM on Monday, May 4."
    both = label + " Leaves Dubai at 9:15 AM on Friday, May 8 and arrives at Hong Kong at 9:00 PM on Friday, May 8."
    df = spark.createDataFrame([(1, label), (2, both), (3, "nothing")], "id long, label string").withColumn("option", fares.parse_label(F.col("label")))
    found = fares.directions(df, F.lit("HKG"), F.lit("DXB"))
    assert sorted((r.id, r.back) for r in found.collect()) == [(1, False), (2, False), (2, True)]
    once = df.selectExpr("option")._jdf.queryExecution().executedPlan().toString().count("From\\s+")
    assert found._jdf.queryExecution().executedPlan().toString().count("From\\s+") == once
