"""Timestamps, spelling variants and the language model: against plain Python, laws, and edges."""

import datetime as dt
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import pitman_yor, timestamps, variants
from ledgerline.session import ship

STAMPS = [
    ("2024-03-31 02:30:00", "s", "Europe/Berlin", ("2024-03-31T01:30", "plain", True)),  # skipped
    ("2024-10-27 02:30", "s", "Europe/Berlin", ("2024-10-27T00:30", "plain", True)),  # twice
    ("2024-10-27 03:00", "s", "Europe/Berlin", ("2024-10-27T02:00", "plain", False)),
    ("2024-10-27 02:30 +0100", "s", "Europe/Berlin", ("2024-10-27T01:30", "plain", False)),
    ("20240229", "s", "Asia/Kolkata", ("2024-02-28T18:30", "plain", False)),
    ("20230229", "s", "UTC", (None, "bad", False)),
    ("01 Feb 2024 12:05 AM", "s", "UTC", ("2024-02-01T00:05", "plain", False)),
    ("01 Feb 2024 13:05 AM", "s", "UTC", (None, "bad", False)),
    ("01.02.2024T23:59:59Z", "s", "UTC", ("2024-02-01T23:59:59", "plain", False)),
    ("2024-01-01 24:00", "s", "UTC", (None, "bad", False)),
    ("2024-01-01 23:60", "s", "UTC", (None, "bad", False)),
    ("2024-01-01 00:00 +15:00", "s", "UTC", (None, "bad", False)),
    ("2024-01-01 00:00 +14:59", "s", None, ("2023-12-31T09:01", "plain", False)),
    ("2024-01-01", "s", None, (None, "bad", False)),
    ("2024-01-01", "s", "Nowhere/Else", (None, "bad", False)),
    ("1700000000", None, None, ("2023-11-14T22:13:20", "epoch", False)),
    (" \t1700000000123\n", None, None, ("2023-11-14T22:13:20.123", "epoch", False)),
    ("13/02/2024", "dm", "UTC", ("2024-02-13T00:00", "plain", False)),
    ("03/02/2024", "dm", "UTC", ("2024-02-03T00:00", "votes", True)),
    ("02/13/2024", "md", "UTC", ("2024-02-13T00:00", "plain", False)),
    ("03/02/2024", "md", "UTC", ("2024-03-02T00:00", "votes", True)),
    ("13/02/2024 25:00", "none", "UTC", (None, "bad", False)),
    ("03/02/2024", "none", "UTC", ("2024-03-02T00:00", "default", True)),
    ("05/05/2024", "none", "UTC", ("2024-05-05T00:00", "plain", False)),
    ("13/02/2024", None, "UTC", ("2024-02-13T00:00", "plain", False)),
    ("03/02/2024", None, "UTC", ("2024-02-03T00:00", "votes", True)),
    ("13/13/2024", "dm", "UTC", (None, "bad", False)),
    ("2024-1-1", "s", "UTC", (None, "bad", False)),
    ("1 feb 2024", "s", "UTC", (None, "bad", False)),
    ("x" * 100_000, "s", "UTC", (None, "bad", False)),
    (None, "s", "UTC", (None, "bad", False)),
    ("", "s", "UTC", (None, "bad", False)),
]


@pytest.fixture(scope="module")
def shipped(spark):
    ship(spark)
    return spark


@pytest.mark.parametrize("hot", [timestamps.HOT, 1])
def test_stamps(shipped, hot):
    """With ``hot`` of 1 most sources meet their votes in the plain join."""
    rows = [(k, source, zone, raw) for k, (raw, source, zone, _) in enumerate(STAMPS)] * 2
    frame = shipped.createDataFrame(rows, "stamp_id long, source string, zone string, raw string").withColumns({c: F.lit("clash") for c in ("wall", "rule", "dm", "bin", "kind")})
    found = timestamps.normalise(frame, hot).collect()
    assert len(found) == len(rows)
    for r in found:
        at, rule, odd = STAMPS[r.stamp_id][3]
        us = None if at is None else round((dt.datetime.fromisoformat(at) - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))
        assert (r.utc_us, r.rule, r.ambiguous) == (us, rule, odd), STAMPS[r.stamp_id]
    assert timestamps.normalise(frame.limit(0)).count() == 0


def test_wall_time_table(shipped):
    """Every zone's wall clock is covered once; offsets are those of the zone rules."""
    from zoneinfo import ZoneInfo

    zones = ["America/St_Johns", "Pacific/Apia", "Africa/Casablanca", "Asia/Kolkata", "Australia/Lord_Howe", "Europe/Berlin"]
    assert set(zones) <= set(timestamps.known_zones(shipped))
    by_zone = defaultdict(list)
    for r in timestamps.intervals(shipped.createDataFrame([(z,) for z in zones], "zone string")).collect():
        by_zone[r.zone].append(r)
    for zone in zones:
        rows = sorted(by_zone[zone], key=lambda r: r.wall_from)
        assert rows[0].wall_from == timestamps.FIRST and rows[-1].wall_to == timestamps.LAST
        assert all(a.wall_to == b.wall_from for a, b in itertools.pairwise(rows))
        for r in rows:
            for second in (r.wall_from, r.wall_to - 1):
                wall = dt.datetime(1970, 1, 1) + dt.timedelta(seconds=second)
                if 2000 <= wall.year < 2026:
                    assert [wall.replace(tzinfo=ZoneInfo(zone), fold=f).utcoffset().total_seconds() for f in (0, 1)] == [r.before, r.after]
            assert (r.kind == "normal") == (r.before == r.after)


# Spelling variants


def plain_words(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def test_variants(shipped):
    rng = np.random.default_rng(5)
    bases = ["repetition", "aaaaaaaaab", "ababababab", "Éléphantine", "straßenbahn", "mississippi", "aaaaaaaaa", "zzzzzzzz"]
    letters = "abmszéñx"
    texts = []
    for k in range(300):
        out = []
        for _ in range(12):
            w = bases[int(rng.integers(len(bases)))]
            for _ in range(int(rng.integers(0, 3)) if rng.random() < 0.5 else 0):
                at, c = int(rng.integers(len(w))), letters[int(rng.integers(len(letters)))]
                w = (w[:at] + c + w[at:], w[:at] + w[at + 1 :], w[:at] + c + w[at + 1 :])[int(rng.integers(3))]
            out.append(w.capitalize() if rng.random() < 0.2 else w)
        texts.append((k, " ".join(out) + "× x_y, "))
    texts += [(None, "Repetition repetition"), (None, None), (7, ""), (9, "k" * 50_000), (9, "k" * 50_000), (10, "K" * 50_000), *texts[:20]]
    want = plain_words(texts)
    near = {w: [v for v in want if one_edit(w, v)] for w in want}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-want[v], v), default=None)
        if best is not None and want[best] >= 10 * want[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    docs = shipped.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("word", "n", "key", "near")})
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.group(docs).collect()}
    assert got == {w: (form.get(w), root(w), n, len(near[w]), want.get(form.get(w))) for w, n in want.items()}
    assert len(form) > 20 and max(map(len, near.values())) > 10
    assert variants.group(docs.limit(0)).count() == 0


def test_near_words_share_a_rare_bigram():
    """Any edit of any word keeps one proposal of the three rarest bigrams, under any order, repeats included."""
    rng = np.random.default_rng(3)
    for _ in range(3000):
        alphabet = "abc"[: int(rng.integers(1, 4))]
        word = "".join(rng.choice(list(alphabet), int(rng.integers(7, 12))))
        at, c = int(rng.integers(len(word))), str(rng.choice(list("abc")))
        other = (word[:at] + c + word[at:], word[:at] + word[at + 1 :], word[:at] + c + word[at + 1 :])[int(rng.integers(3))]
        if len(other) < 7 or other == word:
            continue
        grams = ["".join(g) for g in itertools.product("abc", repeat=2)]
        order = {g: int(k) for g, k in zip(grams, rng.permutation(len(grams)), strict=True)}
        assert set(variants.proposals(word, order)) & set(variants.proposals(other, order)), (word, other)


# The language model


def test_seating_follows_its_conditional():
    """Table counts of a small dish come as often as an enumeration of all seatings says."""
    d, theta, rest, p, n = 0.6, 1.5, 3, 0.2, 5

    def seatings(sizes, left):
        if not left:
            yield sizes
            return
        for k in range(len(sizes)):
            yield from seatings((*sizes[:k], sizes[k] + 1, *sizes[k + 1 :]), left - 1)
        yield from seatings((*sizes, 1), left - 1)

    weight = Counter()
    for sizes in seatings((1,), n - 1):
        shares = math.prod(math.prod(k - d for k in range(1, size)) for size in sizes)
        weight[len(sizes)] += shares * math.prod((theta + d * (rest + k)) * p for k in range(len(sizes)))
    rows = 200_000
    t = pitman_yor.seat(np.full(rows, n), np.full(rows, rest), np.full(rows, p), d, theta, np.random.default_rng(1))
    for k in range(1, n + 1):
        assert abs((t == k).mean() - weight[k] / sum(weight.values())) < 0.005
    large = pitman_yor.seat(np.array([10**9, 41]), np.array([5, 5]), np.array([0.5, 0.5]), d, theta, np.random.default_rng(1))
    assert 1 <= large[1] <= 41 and 1 < large[0] < 10**9


def test_probabilities_sum_to_one():
    c, d, theta = np.array([5, 1, 2, 0, 0]), 0.4, 2.0
    t, p = np.array([2, 1, 1, 0, 0]), np.array([0.3, 0.3, 0.2, 0.1, 0.1])
    total = pitman_yor.predictive(c, t, np.full(5, c.sum()), np.full(5, t.sum()), p, d, theta).sum()
    assert abs(total - 1) < 1e-12
    fits = pitman_yor.fit(np.array([6]), np.array([3]), np.ones(1), d)
    for g, found in zip(pitman_yor.GRID, fits, strict=True):  # but for the power of d, which all share
        want = sum(math.log(g + k * d) for k in range(3)) - sum(math.log(g + k) for k in range(6)) - 3 * math.log(d)
        assert abs(found - want) < 1e-6


@pytest.mark.parametrize("small", [False, True])
def test_language_model(shipped, monkeypatch, small):
    """Counts from plain Python; order of words matters to held-out texts; small parts, buckets and slices change no count."""
    if small:
        for name, value in (("PART_BYTES", 20_000), ("BUCKET", 3_000), ("SLICE", 200)):
            monkeypatch.setattr(pitman_yor, name, value)
    rng = np.random.default_rng(2)
    following = {w: [f"w{int(k)}" for k in rng.integers(0, 60, 3)] for w in (f"w{k}" for k in range(60))}
    docs = [(None, "W1 alone"), (0, None), (1, ""), (2, " \n"), (3, "Only once é É"), (4, "w1 " * 5_000)]
    for k in range(5, 500):
        w, out = "w0", []
        for _ in range(60):
            w = following[w][int(rng.integers(3))]
            out.append(w)
        docs.append((k, " ".join(out)))
    held = [k for k, _ in docs if k is not None and zlib.crc32(str(k).encode()) % 5 == 1 and k >= 5]
    mixed_up = 10_000 + next(k for k in range(100) if zlib.crc32(str(10_000 + k).encode()) % 5 == 1)
    mixed = dict(docs)[held[0]].split()
    docs += [docs[0], (mixed_up, " ".join(sorted(mixed)))]
    frame = shipped.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("h", "part", "score", "c")})
    got = pitman_yor.score(frame).collect()
    tokens = [(k, [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + ["\n"]) for k, t in docs]
    is_held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 5 == 1
    counts = Counter(w for k, ws in tokens if not is_held(k) for w in ws)
    total, known = sum(counts.values()), len(counts)
    want = Counter((k, is_held(k), len(ws), sum(w in counts for w in ws), total, round(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (known + 1))) for w in ws), 6)) for k, ws in tokens)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    by_id = {r.doc_id: r for r in got}
    # Three words follow each: about a third each, where the words alone are one of sixty.
    per_token = sum(by_id[k].score for k in held) / sum(by_id[k].n_tokens for k in held)
    assert -0.62 < per_token < -0.45
    assert by_id[mixed_up].score < by_id[held[0]].score - 30
    assert all(r.score < 0 for r in got)
    assert pitman_yor.score(frame.limit(0)).count() == 0
    alone = pitman_yor.score(frame.where(F.col("doc_id").isin(held))).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and abs(r.score) < 1e-9 and abs(r.base_score) < 1e-9 for r in alone)


def test_a_slice_sees_its_whole_context(monkeypatch):
    """What else is at a context's tables is summed over its slices, not taken to be a slice's own times their number."""
    import pyarrow as pa

    met = {}
    monkeypatch.setattr(pitman_yor, "seat", lambda c, rest, p, d, theta, rng: met.setdefault("rest", list(rest)) and c)
    row = {"bucket": [0], "u": [[7, 7]], "w": [[1, 2]], "c": [[4, 2]], "ctx": [[7]], "ctx_c": [[10]], "slices": [[2]], "hist_c": [[]], "hist_n": [[]], "t": [[3, 1]], "past": [[]]}
    seats = pa.table({k: pa.array(v, pa.int64() if k == "bucket" else pa.list_(pa.int64())) for k, v in row.items()})
    whole = tuple(np.array([x]) for x in (7, 110, 50))
    pitman_yor._sweep(0.5, 8.0, 0, False, whole)(seats, pa.table({"h": [1, 2], "p": [0.5, 0.5]}))
    assert met["rest"] == [47, 49]


def test_the_model_moves_no_row_for_each_word_or_pair(shipped, monkeypatch):
    """What is staged between steps has a row for each bucket and asker, whose numbers the JVM moves as one value."""
    met, stash = {}, pitman_yor.stash

    def seen(df, label, **options):
        met[label] = (out := stash(df, label, **options)).count(), dict(df.dtypes)
        return out

    monkeypatch.setattr(pitman_yor, "stash", seen)
    docs = [(k, " ".join(f"w{(k * j) % 97}" for j in range(40))) for k in range(60)]
    assert pitman_yor.score(shipped.createDataFrame(docs, "doc_id long, text string").repartition(2)).count() == 60
    staged = {label: found for label, found in met.items() if label != "lm-scores"}
    assert len(staged) > 8 and all(n <= 4 for n, _ in staged.values())
    assert all(kinds.get(name, "binary") == "binary" for _, kinds in staged.values() for name in ("h", "w", "c", "t", "past", "places", "place", "pt"))


def test_numbers_pass_through_binary_columns():
    schema = "part long, hs binary, runs binary, large array<long>"
    batch = pitman_yor._rows(schema, part=[1, 2, 3], hs=(np.array([5, -1, 1 << 62]), [0, 1, 1, 3]), runs=(np.array([7, 8]), [0, 0, 2, 2]), large=([4, 5], [0, 1, 2, 2]))
    rows = list(pitman_yor._each(iter([batch.slice(1, 2)])))
    assert [r["hs"].tolist() for r in rows] == [[], [-1, 1 << 62]] and [r["runs"].tolist() for r in rows] == [[7, 8], []]
    assert pitman_yor._flat(batch, "hs").tolist() == [5, -1, 1 << 62] and pitman_yor._lengths(batch, "hs").tolist() == [1, 0, 2]
    assert pitman_yor._flat(batch, "large").tolist() == [4, 5] and pitman_yor._no_rows(schema).num_rows == 0


def test_order_of_pairs_holds_where_words_share_their_upper_bits():
    rng = np.random.default_rng(3)
    for w in (rng.integers(-(1 << 63), 1 << 63, 5_000), rng.integers(0, 4, 5_000) << 5):
        u = rng.integers(-(1 << 63), 1 << 63, 50)[rng.integers(0, 50, len(w))]
        order, want = pitman_yor._in_order(u, w), np.lexsort((w, u))
        assert (u[order] == u[want]).all() and (w[order] == w[want]).all()
