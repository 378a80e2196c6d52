from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import messages, rollup, state

MESSAGES = [
    (1, "Alice", "rent $12,000", datetime(2026, 6, 1, 9)), (2, "Alice", "haircut $300; dinner $50", datetime(2026, 7, 19, 21, 30)), (3, "Alice", "groceries $480; taxi $92", datetime(2026, 7, 19, 11)),
    (4, "Bob", "movie $220; popcorn $60", datetime(2026, 7, 20, 19)), (5, "Bob", "gym $500", datetime(2026, 7, 2, 8)), (6, "Alice", "MTR $5.6; bus $4.8", datetime(2026, 7, 21, 8, 30)),
]


@pytest.fixture(scope="module")
def expenses(spark):
    m = spark.createDataFrame(MESSAGES, "message_id long, member string, text string, ts timestamp_ntz")
    items = messages.parse_messages(m).withColumn("id", F.col("message_id") * 100 + F.col("item_index"))
    keywords = messages.keyword_table(spark, {"popcorn": "Food & Drinks"})
    return messages.resolve(items, keywords, ["id"]).cache()


@pytest.mark.parametrize(("text", "want"), [
    ("haircut $300; dinner $50; Bus $4.8; MTR $5.6; Books $150", [("haircut", 300.0), ("dinner", 50.0), ("Bus", 4.8), ("MTR", 5.6), ("Books", 150.0)]),
    ("rent $12,500, groceries $340", [("rent", 12500.0), ("groceries", 340.0)]),
    ("2 coffees $96", [("2 coffees", 96.0)]), ("paid $88 for taxi", [("taxi", 88.0)]), ("no number here", []), ("", []), (None, []), ("$5", []),
])
def test_parse(spark, text, want):
    m = spark.createDataFrame([(1, "A", text, datetime(2026, 1, 1))], "message_id long, member string, text string, ts timestamp_ntz")
    got = messages.parse_messages(m).orderBy("item_index").collect()
    assert [(r.description, r.amount) for r in got] == want


def test_month(expenses):
    july = expenses.where(rollup.spending_filter(month="2026-07"))
    assert rollup.totals_by(july).first().total == 1712.4
    by = {r.category: r for r in rollup.category_summary(july).collect()}
    assert by["Food & Drinks"].total == 590.0 and by["Food & Drinks"].n == 3
    assert rollup.totals_by(july.where(rollup.spending_filter(member="BOB"))).first().total == 780.0
    day = rollup.top_days(july, 1).first()
    assert str(day.day) == "2026-07-19" and day.total == 922.0
    assert {r.month: r.total for r in rollup.months(expenses).collect()}["2026-06"] == 12000.0
    empty = rollup.totals_by(expenses.where(rollup.spending_filter(month="2020-01"))).first()
    assert empty.total == 0 and empty.n == 0


def test_longest_keyword(spark):
    items = spark.createDataFrame([(1, "Car Park fee"), (2, "bar"), (3, "unknown thing"), (4, "")], "id long, description string")
    got = {r.id: (r.category, r.keyword) for r in messages.resolve(items, messages.keyword_table(spark, {"car": "Other"}), ["id"]).collect()}
    assert got[1] == ("Transportation", "car park") and got[2] == ("Entertainment", "bar") and got[3] == ("Uncategorized", "unknown thing")


def test_learn_and_recategorize(spark, expenses):
    pairs = spark.createDataFrame([("Bubble-Tea!", "Food & Drinks"), ("x", "Nope"), ("!!", "Other")], "keyword string, category string")
    good, bad = messages.learn(pairs)
    assert [r.keyword for r in good.collect()] == ["bubble tea"] and bad.count() == 2
    rows = spark.createDataFrame([(1, "bubble tea", "bubble tea", "Uncategorized"), (2, "x", "x", "Other")], "id long, description string, keyword string, category string")
    got = {r.id: r.category for r in messages.recategorize(rows, good).collect()}
    assert got == {1: "Food & Drinks", 2: "Other"}


def test_reingest_adds_nothing(expenses):
    keys = ["message_id", "item_index"]
    assert state.insert_absent(expenses, expenses, keys).count() == 0


def test_null_keys_are_never_merged(spark):
    old = spark.createDataFrame([(None, 0), (1, 0)], "message_id long, item_index int")
    new = spark.createDataFrame([(None, 0), (None, 0), (1, 0), (2, 0), (2, 0)], "message_id long, item_index int")
    assert state.insert_absent(old, new, ["message_id", "item_index"], null_keys_repeat=True).count() == 3


def test_fold_tail(spark):
    nine = spark.createDataFrame([(f"c{i}", float(i), 1) for i in range(9)], "category string, total double, n long")
    got = {r.slice: r.total for r in rollup.fold_tail(nine).collect()}
    assert got["Other"] == 1.0 and len(got) == 8
    assert rollup.fold_tail(nine.where("category <> 'c0'")).count() == 8


def test_keywords_of_one_and_of_many_words(spark):
    """Only lengths that keywords have are tried, so one of 2,000 words costs a description of 2,000 words one more."""
    long = " ".join(f"w{k}" for k in range(2_000))
    keywords = messages.keyword_table(spark, {"zebra": "Other", long: "Travel"})
    items = spark.createDataFrame([(k, f"x{k} {long} zebra" if k % 2 else " ".join(f"v{j}" for j in range(1_999)) + f" zebra {k}") for k in range(200)], "id long, description string")
    got = {r.id: (r.keyword, r.category) for r in messages.resolve(items, keywords, ["id"]).select("id", "keyword", "category").collect()}
    assert all(got[k] == ((long, "Travel") if k % 2 else ("zebra", "Other")) for k in range(200))
    assert messages.resolve(items, keywords.limit(0), ["id"]).where("category <> 'Uncategorized'").count() == 0
