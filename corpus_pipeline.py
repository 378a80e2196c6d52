"""From raw documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir), with ``docs`` the rows its predecessor
kept, and returns a frame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import mixing, neardup, packing, pii, quality
from ledgerline.llm.common import fresh_name, stash
from ledgerline.llm.queries import vocabulary
from ledgerline.session import read, ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the default policy rejects go.

    Null and empty texts have no words, so they go; repeated rows stay or go together;
    an empty table stays empty; extra columns are passed on, whatever their names.
    """
    ship(spark)
    return quality.keep(docs, fresh_name(docs, "ledger"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: SimHash over five-word shingles, wide enough for Jaccard 0.8, checked on the texts.

    The row of the smallest doc_id stays (null last); null, empty and blank texts are one
    class; repeated rows are copies; extra columns are passed on.
    """
    ship(spark)
    return neardup.survivors(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes its kind in brackets; no document goes.

    A null text stays null; n_chars follows the text where that changed; rows are independent.
    """
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    Null sources are one source; texts without words are never taken; rows that are equal
    share evenly what they are taken.
    """
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mixed documents, placed in sequences.

    A null text is the end token alone; repeated rows are packed as often as they occur;
    an empty table gives no pieces.
    """
    ship(spark)
    # Workers hold what earlier stages left them, so fewer words than op5 remembers.
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), remembered=50_000)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("PII", redact_pii),
    ("mix sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Tokenizing cannot be expressed in SQL. tests/llm/test_pipeline.py holds the first three stages against
#: plain Python, and run() against the stages in turn; mixing and packing have brute-force tests of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
