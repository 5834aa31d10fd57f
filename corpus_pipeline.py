"""A corpus pipeline of five stages; each works on all that its predecessor kept.

Toxic documents go, one document of each near-duplicate group stays, repeated passages and personal data are cut,
and what is left is packed into sequences. A null text is empty in each stage and is packed as its end id alone; a null
id passes without being compared; rows of one id and text count once from the second stage on; an empty table gives none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palate.llm import packing, paragraphs, pii, simhash, toxicity
from palate.llm.common import table, unused
from palate.sources.shared import forget, shared_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the model calls toxic. Columns of docs named as the model's results pass as they are."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score, predicted = (unused(c, docs.columns) for c in ("score", "predicted"))
    return toxicity.score_documents(docs, model, score=score, predicted=predicted).filter(f"{predicted} = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a Jaccard similarity of 0.8."""
    return simhash.keep_one(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand earlier; n_chars follows."""
    return paragraphs.drop_repeated(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars follows."""
    return pii.redact_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, as the packing operator returns them."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: A classifier, near-duplicate groups and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each stage's rows are written as Parquet and read again."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), name)
        if last is not None:
            forget(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
