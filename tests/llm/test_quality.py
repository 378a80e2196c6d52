import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import quality

TEXTS = ["", " \t\n", "a", "a b", "a b c", "a b c a b c", "x\nx\n\nx\n y", "# a # b $ |", "é ü  x", "word " * 60, "a\x0bb\x0cc"]


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen, marked = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            marked |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dups = sum(1 for i, x in enumerate(lines) if x in lines[:i])
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(lines), len(marked)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t#é|\x0b", max_size=40))
def test_measure_is_brute_force(text):
    assert quality.measure(text) == brute(text)


def test_ledger_policies_and_ablations(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(99, None), (99, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "doc_id")
    extra = docs.selectExpr("doc_id", "text", "1 as bits", "2 as kept", "3 as n_words")
    table = quality.ledger(extra)
    got = {r.doc_id: tuple(r[m] for m in quality.MEASURES) for r in table.collect()}
    assert got == {i: brute(t or "") for i, t in rows}
    kept = quality.apply_policy(table)
    assert kept.where("base_failed and kept").count() == 0
    assert kept.where("doc_id = 99").count() == 2
    ablated = {r["rule"]: r for r in quality.ablations(table).collect()}
    assert ablated["few_words"].n_fail == sum(1 for _, t in rows if brute(t or "")[0] < 50)
    assert quality.ledger(extra.limit(0)).count() == 0


def test_bits_are_distinct():
    assert len({r.bit for r in quality.RULES}) == len(quality.RULES)


def test_keep_passes_columns_on(spark):
    text = " ".join(f"word{i}" for i in range(80))
    docs = spark.createDataFrame([(1, text, "x"), (2, "short", "y")], "doc_id long, text string, __ledger string")
    out = quality.keep(docs, "___ledger")
    assert out.columns == docs.columns and [r.doc_id for r in out.collect()] == [1]
