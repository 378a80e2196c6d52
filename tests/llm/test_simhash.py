import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from ledgerline.llm import simhash
from ledgerline.operators.graph import components


def brute_print(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= simhash.RADIUS:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_fingerprint():
    for t in ["", "  \n", "a", "A b", "a b c d", "a b c d e A B C D E", "Éa é x y z", "w " * 500]:
        assert simhash.simhash(t.encode()) == brute_print(t)


def test_close_pairs_is_brute_force():
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(120)]
    values = base + [b ^ sum(1 << k for k in r.sample(range(64), r.randrange(8))) for b in base for _ in range(3)] + [0, 2**64 - 1, 15, 31]
    a = np.array(values, np.uint64)
    for radius in (0, 1, 3, 4, 6, 7, 8, 22, 31):
        got = {p for i, j in simhash.close_pairs(a, a, radius) for p in zip(i.tolist(), j.tolist(), strict=True)}
        assert got == {(p, q) for p in range(len(values)) for q in range(len(values)) if (values[p] ^ values[q]).bit_count() <= radius}


def test_spanning_links_of_a_dense_group(monkeypatch):
    r = random.Random(3)
    centre = r.getrandbits(64)
    values = np.array(sorted({centre ^ sum(1 << k for k in r.sample(range(64), r.randrange(3))) for _ in range(900)} | {r.getrandbits(64) for _ in range(50)}), np.uint64)
    prints = {k: int(v) for k, v in enumerate(values)}
    want = brute_components(prints)
    monkeypatch.setattr(simhash, "ROWS", 32)
    monkeypatch.setattr(simhash, "LANES", 128)
    for left, right in ((values, None), (values[::2].copy(), values[1::2].copy())):
        both = values if right is None else np.concatenate([left, right])
        root = {int(v): int(v) for v in both.view(np.int64)}
        root |= dict(simhash.spanning_links(left, right))
        group = {}
        for k, v in enumerate(values.view(np.int64)):
            group.setdefault(root[int(v)], set()).add(want[k])
        if right is None:
            assert len(group) == len(set(want.values())) and all(len(g) == 1 for g in group.values())
        else:
            assert all(len(g) == 1 for g in group.values())


def test_parts_cover_all_pairs():
    for n in (10, 10**6, 10**9, 10**12):
        parts, shared = simhash.plan_parts(n)
        assert parts - shared == simhash.RADIUS
        assert len(simhash._keys(parts, shared)) == len({m for _, m in simhash._keys(parts, shared)})


def test_classes_are_brute_force(spark, monkeypatch):
    r = random.Random(2)
    texts = {}
    for i in range(60):
        words = [f"w{r.randrange(500)}" for _ in range(r.choice([1, 3, 5, 200, 400]))]
        texts[i] = " ".join(words)
        for k in range(r.randrange(4)):
            near = list(words)
            near[r.randrange(len(near))] = "changed"
            texts[1000 + 10 * i + k] = " ".join(near)
    texts |= {5000: "", 5001: " ", 5002: texts[0], 5003: texts[0]}
    docs = spark.createDataFrame([(i, t, 7, 8) for i, t in texts.items()] + [(5004, None, 7, 8)], "doc_id long, text string, fp int, component_id int")
    texts[5004] = ""
    prints = {i: brute_print(t) for i, t in texts.items()}
    want = brute_components(prints)
    for chunk in (simhash.CHUNK, 2):  # the second sends every bucket through chunk pairs
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        got = simhash.classes(docs).withColumn("hex", simhash.hex_fingerprint(F.col("fp"))).collect()
        assert {g.doc_id: g.component_id for g in got} == want
        assert {g.doc_id: g.hex for g in got} == {i: f"{p:016x}" for i, p in prints.items()}


def test_survivors(spark):
    t = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([(3, t, "s"), (1, t, "s"), (1, t, "s"), (2, "other words here at all", "s"), (None, "lost", "s"), (None, "lost", "s")], "doc_id long, text string, label string")
    out = simhash.survivors(docs)
    assert out.columns == docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "2", "None"]
    assert simhash.survivors(docs.limit(0)).count() == 0


def test_components_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.id: r.label for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_components_of_long_chains_end_soon(spark):
    r = random.Random(4)
    ids = r.sample(range(10**9), 4000)
    sorted_ids = list(range(2 * 10**9, 2 * 10**9 + 3000))
    star = [(3 * 10**9 + 5000, 3 * 10**9 + k) for k in range(1000)]
    edges = [*zip(ids, ids[1:], strict=False), *zip(sorted_ids, sorted_ids[1:], strict=False), *star]
    r.shuffle(edges)
    rounds = []
    got = {x.id: x.label for x in components(spark.createDataFrame(edges, "a long, b long"), rounds).collect()}
    assert got == {i: min(ids) for i in ids} | {i: sorted_ids[0] for i in sorted_ids} | {i: 3 * 10**9 for e in star for i in e}
    assert len(rounds) <= 15


def test_survivors_with_repeated_and_null_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(80)) for x in "abc")
    for rows, want in (
        ([(3, a), (7, a), (7, b)], [(3, a), (7, b)]),  # an id with two texts of different classes
        ([(5, b), (5, c)], [(5, b), (5, c)]),
        ([(1, a), (None, a), (None, b), (None, b)], [(1, a), (None, b)]),  # a null id beside a named one, and a class of null ids
    ):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted(map(str, map(tuple, simhash.survivors(docs).collect()))) == sorted(map(str, want))
