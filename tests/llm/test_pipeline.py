import random
import re
from collections import Counter

import corpus_pipeline
from ledgerline.llm import packing
from ledgerline.llm.queries import vocabulary

from test_neardup import kept_by_brute_force

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra int"


def fixture_rows():
    """Null and short texts, null ids, repeated rows, near copies, an e-mail address."""
    r = random.Random(8)
    texts = [" ".join(f"word{r.randrange(4000)}" for _ in range(120)) for _ in range(12)]
    rows = list(enumerate(texts))
    rows += [(100 + k, " ".join("edited" if j == 7 * k + 3 else w for j, w in enumerate(texts[k].split()))) for k in range(4)]
    rows += [(3, texts[3]), (3, texts[3]), (200, texts[5]), (None, texts[6]), (201, None), (202, "too short"), (None, None)]
    rows += [(300, " ".join(f"other{k}" for k in range(60)) + " write to ann@example.com today")]
    return [(d, t, "en", "web" if (d or 0) % 2 else "books", len(t or ""), 7) for d, t in rows]


def clean(text):
    """The default policy, as far as these texts can fail it: 50 words."""
    return len((text or "").split()) >= 50


def key(rows):
    return Counter((r[0], r[1]) for r in rows)


def test_stages_and_run_are_plain_python(spark, tmp_path):
    rows = fixture_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stages, sf = dict(corpus_pipeline.STAGES), str(tmp_path)
    good = [x for x in rows if clean(x[1])]
    got = stages["quality rules"](spark, docs, sf)
    assert got.columns == docs.columns and key(got.collect()) == key(good)

    got = stages["SimHash near-dedup"](spark, spark.createDataFrame(good, SCHEMA), sf)
    assert got.columns == docs.columns
    apart = got.collect()
    assert sorted((x.doc_id is None, x.doc_id or 0) for x in apart) == kept_by_brute_force([x[:2] for x in good])
    assert set(key(apart)) <= set(key(good))

    got = stages["PII"](spark, spark.createDataFrame(apart, SCHEMA), sf)
    redacted = got.collect()
    plain = Counter((x.doc_id, re.sub(r"\S+@\S+\.com", "ADDRESS", x.text)) for x in apart)
    assert got.columns == docs.columns and Counter((x.doc_id, re.sub(r"\[\w+\]", "ADDRESS", x.text)) for x in redacted) == plain

    got = stages["mix sources"](spark, spark.createDataFrame(redacted, SCHEMA), sf)
    mixed = got.collect()
    assert got.columns == docs.columns and mixed and set(key(mixed)) <= set(key(redacted))

    # run() is the stages one after the other, down to the last packed piece
    want = packing.pack_documents(spark.createDataFrame(mixed, SCHEMA), vocabulary("word_bpe_49k.json"))
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == want.columns and out.count() == want.count() > 0
    ids = [c for c in out.columns if c == "doc_id"]
    assert Counter(map(tuple, out.select(*ids).collect())) == Counter(map(tuple, want.select(*ids).collect()))


def test_stages_of_an_empty_table(spark, sf):
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0, name
