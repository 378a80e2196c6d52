from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import coupons, state
from ledgerline.streaming import ingest

C = "id string, account_id string, merchant string, title string, expires_on date, status string, media_id string, uses_total int, conditions array<struct<kind:string,params:map<string,string>,text:string>>"
NOW = datetime(2026, 8, 5, 12)


def coupon(spark, *conditions, status="active", expires=date(2026, 9, 30)):
    return spark.createDataFrame([("c", "Alice", "Cafe", "$20 off", expires, status, "m", 2, [(k, p, None) for k, p in conditions])], C)


def usable(df, at=NOW, channel=None, location=None):
    lit = lambda v, t: F.lit(v).cast(t)
    return coupons.usable_now(df, lit(at, "timestamp_ntz"), lit(channel, "string"), lit(location, "string")).collect()


LUNCH = ("time_window", {"days": '["0","1","2","3","4"]', "from": "11:30", "to": "14:30"})


@pytest.mark.parametrize(("condition", "kw", "ok", "caveats"), [
    (LUNCH, {"at": datetime(2026, 8, 5, 14, 30)}, True, 0), (LUNCH, {"at": datetime(2026, 8, 5, 14, 31)}, False, 0), (LUNCH, {"at": datetime(2026, 8, 8, 12)}, False, 0),
    (("time_window", {"from": "22:00", "to": "02:00"}), {"at": datetime(2026, 8, 5, 23, 30)}, True, 0), (("time_window", {"from": "22:00", "to": "02:00"}), {"at": datetime(2026, 8, 5, 1, 30)}, True, 0), (("time_window", {"from": "22:00", "to": "02:00"}), {}, False, 0),
    (("channel", {"allow": '["online"]'}), {}, True, 1), (("channel", {"allow": '["online"]'}), {"channel": "online"}, True, 0), (("channel", {"allow": '["online"]'}), {"channel": "shop"}, False, 0),
    (("location", {"branches": '["Mong Kok"]'}), {"location": "mong kok mall"}, True, 0), (("location", {"region": "HK"}), {"location": "Paris"}, False, 0), (("location", {}), {"location": "x"}, True, 1),
    (("date_window", {"from": "2026-08-06"}), {}, False, 0), (("date_window", {"to": "2026-08-05"}), {}, True, 0), (("min_spend", {"amount": "100"}), {}, True, 1), (("strange", {}), {}, True, 1),
])
def test_conditions(spark, condition, kw, ok, caveats):
    got = usable(coupon(spark, condition), **kw)
    assert bool(got) == ok and (not ok or len(got[0].caveats) == caveats)


def test_expired_is_not_usable(spark):
    assert not usable(coupon(spark, expires=date(2026, 8, 4))) and usable(coupon(spark, expires=date(2026, 8, 5)))


def test_validation(spark):
    bad = [("channel", {}), ("time_window", {"from": "25:00"}), ("time_window", {"days": '["9"]'}), ("date_window", {"from": "soon"}), ("min_spend", {"amount": "x"}), ("nope", {})]
    for b in bad:
        valid, rejected = coupons.split_valid(coupon(spark, LUNCH, b))
        assert valid.count() == 0 and rejected.first().reason, b
    assert coupons.split_valid(coupon(spark, LUNCH, ("other", {})))[0].count() == 1


@pytest.mark.parametrize(("events", "status", "remaining", "errors"), [
    (["use"], "active", 1, 0), (["use", "use"], "used", 0, 0), (["use", "use", "use"], "used", 0, 0), (["use", "use", "unuse"], "active", 2, 0), (["void", "use"], "void", 2, 1), (["expire", "extend"], "active", 2, 0), (["void", "extend"], "void", 2, 1), (["resolve"], "active", 2, 1), ([], "active", 2, 0),
])
def test_lifecycle(spark, events, status, remaining, errors):
    log = spark.createDataFrame([("c", datetime(2026, 8, 5, 12, n), n, k, None) for n, k in enumerate(events)], "id string, at timestamp_ntz, seq long, kind string, arg string")
    got = coupons.lifecycle(coupon(spark), log).first()
    assert (got.status, got.remaining, got.errors) == (status, remaining, errors)


def test_undo_window(spark):
    log = spark.createDataFrame([("c", NOW, 1, "use", "2"), ("c", datetime(2026, 8, 7, 12), 2, "unuse", None)], "id string, at timestamp_ntz, seq long, kind string, arg string")
    assert coupons.lifecycle(coupon(spark), log).first().errors == 1


def test_sweep_twice(spark):
    today = F.lit(date(2026, 10, 1))
    once = coupons.swept(coupon(spark), today)
    assert once.first().status == "expired" and coupons.swept(once.drop("swept"), today).first().swept is False


def test_references(spark):
    rows = [("1", "A", "used", "m1"), ("2", "A", "active", "m1"), ("3", "A", "used", "m2"), ("4", "B", "used", "m1")]
    df = spark.createDataFrame(rows, "id string, account_id string, status string, media_id string")
    got = {(r.account_id, r.media_id): r.released for r in coupons.purge_manifest(df, F.col("status") == "used").collect()}
    assert got == {("A", "m1"): False, ("A", "m2"): True, ("B", "m1"): True}
    scope = coupons.Scoped("A", coupon=df)
    assert scope["coupon"].count() == 3 and scope.find("coupon", "4").count() == 0
    media = spark.createDataFrame([("m1", "A"), ("m9", "A")], "media_id string, account_id string")
    assert [r.id for r in coupons.dangling(df, media).orderBy("id").collect()] == ["3", "4"]
    assert [r.media_id for r in coupons.unreferenced(media, df).collect()] == ["m9"]


def test_ledger(spark):
    items = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, source string")
    none = spark.createDataFrame([], state.Ledger.SCHEMA)
    now = F.lit(NOW).cast("timestamp")
    seed = state.Ledger(none, "n").seed(items.where("source = 'a'"), F.col("id"), ["source"], now)
    ledger = state.Ledger(seed, "n")
    assert [r.id for r in ledger.pending(items, F.col("id")).collect()] == [3]
    assert ledger.stamp(items, F.col("id"), now).count() == 1
    later = items.unionByName(spark.createDataFrame([(4, "a"), (5, "c")], items.schema))
    assert sorted(r.key for r in ledger.seed(later, F.col("id"), ["source"], now).collect()) == ["3", "5"]


def test_merge_and_versions(spark, tmp_path):
    table = state.Versioned(spark, str(tmp_path / "t"), "k long, v string, made string")
    assert table.read().count() == 0
    table.commit(spark.createDataFrame([(1, "a", "old"), (2, "b", "old")], "k long, v string, made string"))
    new = spark.createDataFrame([(2, "c", "new"), (3, "d", "new")], "k long, v string, made string")
    for _ in range(2):  # twice: the same
        table.commit(state.merge(table.read(), new, ["k"], keep=["made"]))
        assert sorted(map(tuple, table.read().collect())) == [(1, "a", "old"), (2, "c", "old"), (3, "d", "new")]
    assert table.version() == 3


def test_a_merge_writes_only_files_with_its_keys(spark, tmp_path):
    schema = "k long, v string, made string"
    table = state.Versioned(spark, str(tmp_path / "t"), schema, ["k"])
    rows = spark.range(8_000).selectExpr("id * 2 as k", "'a' as v", "'old' as made")
    table.commit(rows.repartitionByRange(8, "k"))
    table.append(spark.range(1).selectExpr("100001L as k", "'far' as v", "'old' as made"))
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "t").glob("v*/*.parquet")}
    first, before = table.read(), files()
    ten = spark.createDataFrame([(k, "b", "new") for k in (*range(10, 26, 2), 3, 15_999)], schema)  # eight there, two new
    want = sorted(map(tuple, state.merge(first, ten, ["k"], keep=["made"]).collect()))
    version = table.merge(ten, keep=["made"])
    assert sorted(map(tuple, table.read().collect())) == want
    assert {p: t for p, t in files().items() if p in before} == before  # nothing is written over
    now = table.folders(version)
    assert len(now) == 7 + 1 + 1 and sum("/" in f for f in now) == 7  # seven old files by name, the far folder, the new one
    sizes = {r[0]: (r[1], r[2]) for r in first.groupBy("_metadata.file_path").agg(F.count("*"), F.min("k")).collect()}
    assert spark.read.parquet(f"{tmp_path}/t/{now[-1]}").count() == next(n for n, least in sizes.values() if least == 0) + 2  # one file's rows and the new keys
    again = table.merge(ten, keep=["made"])  # the same once more: the same rows
    assert sorted(map(tuple, table.read().collect())) == want and again == version + 1
    assert sorted(map(tuple, table.read(1).collect())) == sorted(map(tuple, rows.collect()))
    # Types that differ from the table's still meet; null keys are added; nothing to merge changes nothing.
    table.merge(spark.createDataFrame([(10, "int", "x"), (None, "null", "x")], "k int, v string, made string"))
    assert table.read().where("k = 10").first().v == "int" and table.read().where("k is null").count() == 1
    assert table.merge(ten.limit(0)) == again + 2 and table.read().count() == len(want) + 1


def test_only_folders_that_may_hold_a_key_are_opened(spark, tmp_path):
    """Batch after batch: what a batch reads of the table does not grow with it; texts and pairs as keys; a table from before the filters."""
    table = state.Versioned(spark, str(tmp_path / "t"), "k long, s string", ["k", "s"])
    table.least_filtered = 0
    step, opened = ingest.absent_into(table, ["k", "s"]), []
    for n in range(30):
        # Keys spread over all ranges; a tenth repeats the batch before.
        batch = spark.range(n * 180, n * 180 + 200).selectExpr("(id * 7919) % 100003 as k", "concat('s', id) as s")
        opened.append(table.read_for(batch).count())
        step(batch, n)
    assert table.read().count() == 30 * 180 + 20 == table.read().distinct().count()
    assert min(opened[1:]) >= 180 and max(opened[20:]) <= 2_000 and sum(opened[20:]) / 10 < 1_000
    assert table.holding(spark.createDataFrame([(-5, "s1")], "k long, s string")) == []
    old = state.Versioned(spark, str(tmp_path / "old"), "k long")
    old.commit(spark.range(10).withColumnRenamed("id", "k"))
    keyed = state.Versioned(spark, str(tmp_path / "old"), "k long", ["k"])
    ingest.absent_into(keyed, ["k"])(spark.range(5, 15).withColumnRenamed("id", "k"), 0)
    assert sorted(r.k for r in keyed.read().collect()) == list(range(15))


def test_a_coupon_expires_by_the_watermark_alone(spark, tmp_path):
    at = lambda d, h=0: datetime(2026, 1, d, h)
    schema = "id string, at timestamp, seq long, kind string, until timestamp"
    rows = [
        [("a", at(1), 1, "add", at(3)), ("b", at(1), 1, "add", at(3)), ("c", at(1), 1, "add", at(3)), ("d", at(1), 1, "add", at(20))],
        [("b", at(2), 2, "extend", at(10)), ("c", at(2), 2, "use", None), ("c", at(2), 3, "extend", at(3))],
        [("e", at(5), 1, "add", at(30))],  # the clock moves past the third; nothing is said of a
        [("e", at(12), 2, "void", None)],
    ]
    for batch in rows:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = []
    stream = ingest.expiries(ingest.landing(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, files_per_batch=1))
    ingest.into(stream, str(tmp_path / "ck"), lambda df, n: got.extend((r.id, r.status, r.at.day) for r in df.collect()))
    assert [g for g in got if g[1] == "expired"] == [("a", "expired", 3), ("b", "expired", 10)]
    assert sorted(g[:2] for g in got if g[1] != "expired") == sorted([("a", "active"), ("b", "active"), ("b", "active"), ("c", "active"), ("c", "used"), ("d", "active"), ("e", "active"), ("e", "void")])


def test_writers_do_not_replace_each_other(spark, tmp_path):
    import pytest

    path, schema = str(tmp_path / "t"), "k long"
    rows = lambda *ks: spark.createDataFrame([(k,) for k in ks], schema)
    one, two = state.Versioned(spark, path, schema), state.Versioned(spark, path, schema)
    one.commit(rows(1))
    assert one.append(rows(2, 3)) == 2 and sorted(r.k for r in two.read().collect()) == [1, 2, 3]
    assert [r.k for r in two.read(1).collect()] == [1] and sorted(r.k for r in two.added(2).collect()) == [2, 3]
    folder = two._write(rows(9), 3)  # a writer that has not published yet
    assert one.append(rows(4)) == 3
    with pytest.raises(state.Conflict):
        two._publish(3, [*two.folders(2), folder])
    assert sorted(r.k for r in one.read().collect()) == [1, 2, 3, 4]
    assert one.commit(one.read()) == 4 and len(one.folders(4)) == 1 and one.read().count() == 4
    assert not [p for p in (tmp_path / "t" / "_log").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def test_migrations_run_once(spark, tmp_path):
    import pytest

    table = state.Versioned(spark, str(tmp_path / "t"), "k long, v string")
    table.commit(spark.createDataFrame([(1, None)], "k long, v string"))
    steps = {"0002_twice": lambda d: d.withColumn("k", F.col("k") * 10), "0001_fill": lambda d: d.withColumn("v", F.coalesce("v", F.lit("none")))}
    assert table.migrate(steps) == ["0001_fill", "0002_twice"] and table.migrate(steps) == []
    table.append(spark.createDataFrame([(2, "x")], "k long, v string"))
    assert table.applied() == ["0001_fill", "0002_twice"] and sorted(map(tuple, table.read().collect())) == [(2, "x"), (10, "none")]
    with pytest.raises(Exception, match="nowhere"):
        table.migrate(steps | {"0003_bad": lambda d: d.select("nowhere")})
    assert table.applied() == ["0001_fill", "0002_twice"]


def test_compaction(spark):
    log = spark.range(401).withColumnRenamed("id", "at")
    assert state.compact(log, "at").count() == 200 and state.compact(log.where("at < 400"), "at").count() == 400


def test_stream_equals_batch(spark, tmp_path, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "event_type", "value")
    e.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = lambda: ingest.landing(spark, str(tmp_path / "in"), e.schema, files_per_batch=1)
    table = state.Versioned(spark, str(tmp_path / "out"), "event_id long, ts timestamp_ntz, event_type string, value double")
    for _ in range(2):  # a replay from a new checkpoint adds nothing
        ingest.into(stream(), str(tmp_path / f"ck{_}"), ingest.absent_into(table, ["event_id"]))
    assert sorted(r.event_id for r in table.read().collect()) == sorted(r.event_id for r in e.collect())
    got = []
    ingest.into(ingest.tumbling(stream(), "ts", "1 day", ["event_type"], "value", delay="60 days"), str(tmp_path / "ck3"), lambda df, _: got.extend(df.collect()))
    assert len({(r.start, r.event_type) for r in got}) == len(got)


def test_streamed_changes(spark, tmp_path):
    rows = [("s", datetime(2026, 1, d), v) for d, v in ((1, 4.50), (2, 4.54), (3, 4.58), (4, 4.62), (5, 4.70), (6, 4.73))]
    df = spark.createDataFrame(rows, "series string, as_of timestamp, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = []
    ingest.into(ingest.changes(ingest.landing(spark, str(tmp_path / "in"), df.schema), 0.10), str(tmp_path / "ck"), lambda b, _: got.extend(b.collect()))
    assert [(r.value, r.previous) for r in got] == [(4.62, 4.50), (4.73, 4.62)]
