import math
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from ledgerline.llm import mixing, sharding


def test_shards_are_near_equal_and_gapless(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(-5, None, "en", "s", 0), (-6, "", "en", "s", 0), (None, "x", None, None, 1)], docs.schema))
    placed, plan = sharding.assign(docs)
    rows = placed.collect()
    texts = {d.doc_id: d.text or "" for d in docs.collect()}
    per, load = defaultdict(list), Counter()
    for r in rows:
        assert r["size"] == len(texts[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        assert plan.at()[r.virtual_slot] == r.shard
        per[r.shard].append(r.slot)
        load[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in per.values())
    assert max(load.values()) - min(load.values()) <= max(0.02 * sum(load.values()) / 24, max(len(t.encode()) for t in texts.values()))
    again, _ = sharding.assign(docs)
    assert sorted(map(str, again.collect())) == sorted(map(str, rows))


def test_slot_map_versions():
    sizes = {s: 1 + s % 7 for s in range(64)}
    plan = sharding.SlotMap(64, 4).rebalance(sizes)
    assert plan.version == 1 and plan.at(0) == [s % 4 for s in range(64)]
    grown = plan.rebalance(sizes, shards=5)
    assert grown.at(1) == plan.at() and set(grown.at()) == set(range(5))
    load = Counter()
    for s, shard in enumerate(grown.at()):
        load[shard] += sizes[s]
    assert max(load.values()) - min(load.values()) <= 2


def test_null_and_repeated_ids_are_spread(spark):
    docs = spark.createDataFrame([(None, "same text", "x", 1) for _ in range(6000)] + [(4, f"t{k}", "x", 1) for k in range(6000)], "doc_id long, text string, virtual_slot string, copy int")
    placed, plan = sharding.assign(docs)
    load = {r.shard: (r.b, r.n) for r in placed.groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}
    assert sum(n for _, n in load.values()) == 12000 and set(load) == set(range(24))
    bytes_ = [b for b, _ in load.values()]
    assert max(bytes_) - min(bytes_) <= 0.02 * sum(bytes_) / 24


def test_the_map_is_stored_and_edited(spark, sf, tmp_path):
    docs, path = spark.read.parquet(f"{sf}/documents.parquet"), str(tmp_path / "map")
    placed, plan = sharding.assign(docs, map_path=path)
    assert plan.version == 1 and sharding.SlotMap.load(spark, path) == plan
    again, same = sharding.assign(docs, map_path=path)  # near equal already: no new version
    assert same == plan and sorted(map(str, again.collect())) == sorted(map(str, placed.collect()))
    grown, wider = sharding.assign(docs, shards=25, map_path=path)
    assert wider.version == 2 and wider.at(1) == plan.at() and sharding.SlotMap.load(spark, path) == wider
    slots = {(r.doc_id, r["size"]): r.virtual_slot for r in placed.collect()}
    assert all(slots[r.doc_id, r["size"]] == r.virtual_slot for r in grown.collect())
    narrow, less = sharding.assign(docs, shards=20, map_path=path)
    assert less.version == 3 and max(less.at()) == 19
    (tmp_path / "map" / "version=4").mkdir()  # a writer that did not finish
    assert sharding.newest_version(spark, path) == 3


def test_the_query_takes_up_the_map_of_an_earlier_run(spark, tmp_path):
    """A second run finds the first one's map; with other documents it edits that map, and keeps its versions."""
    from ledgerline.llm import queries

    docs = lambda n, size: spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 97 == 0, F.repeat(F.lit("x"), size)).otherwise("short").alias("text"))
    docs(20_000, 10).write.parquet(str(tmp_path / "documents.parquet"))
    versions = lambda: {r.map_version for r in queries.op8_sharding(spark, str(tmp_path)).select("map_version").distinct().collect()}
    first = versions()
    assert versions() == first
    docs(20_000, 3_000).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    (edited,) = versions()
    assert edited > max(first)
    load = [r.b for r in queries.op8_sharding(spark, str(tmp_path)).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert max(load) - min(load) <= 0.02 * sum(load) / 24 + 3_008


def test_empty_shards(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    placed, _ = sharding.assign(docs)
    assert placed.count() == 0


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        w = sum(weight[s] for s in names if s not in full)
        target = {s: 2 * sizes[s] if s in full else rest * weight[s] / w for s in names}
        over = {s for s in names if target[s] > 2 * sizes[s]}
        if not over:
            return target
        full |= over


def check(docs):
    rows = mixing.take(docs).collect()
    given = docs.select("doc_id", "text", "source").collect()
    size = Counter()
    for d in given:
        size[d.source] += len(re.findall(r"[^\x20\x09-\x0D]+", d.text or ""))
    want = brute_targets(size)
    taken, largest = Counter(), Counter()
    assert len(rows) == len(given)
    for r in rows:
        assert r.source_size == size[r.source] and math.isclose(r.target, want[r.source], abs_tol=1e-6)
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    for s, t in want.items():
        assert abs(taken[s] - t) <= largest[s]
    return rows


def test_mix(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    more = spark.createDataFrame([(-1, None, None), (-2, "", None), (-3, "a b c", None), (-3, "a b c", None), (None, "q r", "Ω"), (-4, "x y", "empty"), (-5, None, "void")], "doc_id long, text string, source string")
    docs = docs.unionByName(more)
    rows = check(docs)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.take(docs).collect()))
    monkeypatch.setattr(mixing, "SLICE", 5)
    sliced = check(docs)
    key = lambda r: (str(r.doc_id), r["size"], r.taken)
    assert sorted(map(key, sliced)) == sorted(map(key, rows))


def test_quality_weighs(spark):
    good, bad = "plain words only here", "### $$$ %%% &&&"
    docs = spark.createDataFrame([(i, good if i % 2 else bad, "a") for i in range(2000)] + [(i, "w " * 9000, "b") for i in range(2000, 2002)], "doc_id long, text string, source string")
    taken = mixing.take(docs, weights=(1.0, 9.0)).where("source = 'a'").groupBy((F.col("doc_id") % 2).alias("good")).agg(F.sum("epochs_taken").alias("n")).collect()
    n = {r.good: r.n for r in taken}
    assert n[1] > 2 * n.get(0, 0)


def test_mix_rows(spark):
    docs = spark.createDataFrame([(i, f"w{i} " * (1 + i % 5), f"s{i % 4}", i, i) for i in range(200)], "doc_id long, text string, source string, size int, key int")
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    taken = {r.doc_id: r.epochs_taken for r in mixing.take(docs).collect()}
    assert Counter(r.doc_id for r in out.collect()) == Counter({k: v for k, v in taken.items() if v})
    assert mixing.mix(docs.limit(0)).count() == 0


def test_slices_are_even_for_any_weights(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE", 200)
    texts = {1: "###### 1", 7: "words ####", 20: "plain words only"}
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 30_000, texts[1]).when(F.col("id") < 36_000, texts[7]).otherwise(texts[20]).alias("text"), F.lit("a").alias("source"))
    sizes = [r.n for r in mixing.take(docs).groupBy("slice").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 200 and max(sizes) <= 4 * 200


def test_equal_rows_are_spread(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE", 20)
    docs = spark.createDataFrame([(1, "same words", "a", k) for k in range(500)] + [(2, "b " * 4000, "b", 0)], "doc_id long, text string, source string, n_chars long")
    taken = mixing.take(docs)
    assert taken.where("source = 'a'").groupBy("slice").count().count() > 5
    n = taken.where("source = 'a'").agg(F.sum("epochs_taken")).first()[0]
    out = mixing.mix(docs).where("source = 'a'").groupBy("n_chars").count().collect()
    assert sum(r["count"] for r in out) == n and max(r["count"] for r in out) - min(r["count"] for r in out) <= 1
