import random

import numpy as np

import corpus_pipeline
from ledgerline.llm import neardup


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept_by_brute_force(rows):
    """The rows (doc_id, text) that stay: one of each class by (doc_id, nulls last)."""
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for j in range(len(rows)):
        for i in range(j):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(j)] = find(i)
    best = {}
    for i, (d, _) in enumerate(rows):
        best.setdefault(find(i), []).append((d is None, d or 0))
    return sorted(min(b) for b in best.values())


def edited_copies(r, families):
    """Texts with copies of a few changed words, around the least similarity; a common line in each."""
    rows, line = [], " ".join(f"licence{i}" for i in range(30))
    for f in range(families):
        words = [f"w{r.randrange(3000)}" for _ in range(r.choice([60, 100, 250]))]
        rows.append((10 * f, " ".join(words) + " " + line))
        for k in range(1, r.randrange(1, 5)):
            near = list(words)
            for _ in range(r.randrange(1, max(2, len(words) // 25))):
                near[r.randrange(len(near))] = f"new{r.randrange(10**6)}"
            rows.append((10 * f + k, " ".join(near) + " " + line))
    return rows


def test_similar_sets_meet():
    """Of 2000 pairs just over the least similarity, all share a band and lie within the radius."""
    r = random.Random(4)
    for _ in range(2000):
        both = [r.getrandbits(64) for _ in range(80)]
        a, b = (np.array(sorted(both + [r.getrandbits(64) for _ in range(10)]), np.uint64) for _ in range(2))
        assert neardup.similar(a, b)
        assert set(neardup.bands(a).tolist()) & set(neardup.bands(b).tolist())
        assert ((neardup.fingerprint(a) ^ neardup.fingerprint(b)) & (2**64 - 1)).bit_count() <= neardup.RADIUS


def test_stage_drops_edited_copies(spark, sf, monkeypatch):
    rows = edited_copies(random.Random(5), 40)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [d for _, d in kept_by_brute_force(rows)]
    assert len(want) < len(rows) - 20
    assert sorted(x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, sf).collect()) == want
    for chunk in (neardup.CHUNK, 2):  # a bucket goes through chunk pairs; a third of all rows are one near-copy group
        monkeypatch.setattr(neardup, "CHUNK", chunk)
        r = random.Random(6)
        base = [f"w{k}" for k in range(90)]
        group = [(5000 + k, " ".join(f"x{r.randrange(10**6)}" if j in (r.randrange(90), r.randrange(90)) else w for j, w in enumerate(base))) for k in range(60)]
        more = rows + group
        got = neardup.survivors(spark.createDataFrame(more, "doc_id long, text string")).collect()
        assert sorted(x.doc_id for x in got) == [d for _, d in kept_by_brute_force(more)]


def test_pairs_of_sets(monkeypatch):
    r = random.Random(9)
    base = [r.getrandbits(64) for _ in range(60)]
    sets = [np.array(sorted({x for x in base if r.random() < 0.92} | {r.getrandbits(64) for _ in range(r.randrange(5))}), np.uint64) for _ in range(40)] + [np.zeros(0, np.uint64)]
    i, j = (np.array(x) for x in zip(*[(a, b) for a in range(41) for b in range(a)], strict=True))
    want = [neardup.similar(sets[a], sets[b]) for a, b in zip(i, j, strict=True)]
    assert 50 < sum(want) < 750
    for wide in (neardup.WIDE, 45, 1):
        monkeypatch.setattr(neardup, "WIDE", wide)
        assert neardup.similar_pairs(sets, i, j).tolist() == want


def test_a_large_group_and_a_stranger(spark):
    """Rows of a bucket move in proportion to it where one label has most of them; every pair across labels meets, whatever the shares."""
    for labels in ([0] * 5_000 + [1], [0] * 3_000 + [1] * 700 + [2] * 300, [k % 7 for k in range(900)], [0, 1], [5]):
        rows = [(1, 2, k, label) for k, label in enumerate(labels)]
        met = spark.createDataFrame(rows, "k int, part long, row long, label long")
        dealt = neardup.across(met, 256).collect()
        groups = {}
        for r in dealt:
            groups.setdefault((r.lo, r.hi), []).append(r)
        if labels.count(0) == 5_000:
            assert len(dealt) <= 1.1 * len(labels)
            assert sum(r.row == 5_000 for r in dealt if r["first"]) == 20  # the stranger meets each chunk of all
        seen = set()
        for (lo, hi), members in groups.items():
            left = [r.row for r in members if r["first"]] if lo != hi else [r.row for r in members]
            right = [r.row for r in members if not r["first"]] if lo != hi else left
            assert len(set(left)) <= 1.5 * 256 and len(set(right)) <= 1.5 * 256
            seen |= {(min(a, b), max(a, b)) for a in left for b in right if labels[a] != labels[b]}
        assert len(seen) == sum(labels.count(x) * (len(labels) - labels.count(x)) for x in set(labels)) // 2
