"""A corpus pipeline of five stages over ``documents``.

Every stage takes (spark, docs, sf_dir); its rows are written as Parquet and read again as the next one's docs. All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docprobe.llm import packing, secret_scan, simhash, systematic_mix, toxicity
from docprobe.llm.common import stored


#: From this toxicity score on a document goes: on the cautious side of the 0.3 that a report flags, so that clean documents stay.
REJECT = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go.

    Null and empty texts score as texts without tokens, and stay unless the labels are toxic nearly throughout; repeated rows meet the same fate; without labels of both kinds
    every row stays; an empty table gives no rows; other columns go through untouched.
    """
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), REJECT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal or similar texts stays: the one with the smallest doc_id, once.

    Null and empty texts are equal texts; rows without a doc_id stay, as no smallest id can stand for them; very long texts are compared whole; other columns
    go through untouched; an empty table gives no rows.
    """
    return simhash.without_near_duplicates(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; no document goes.

    A null text stays null, an empty one empty; repeated rows and null ids stay; n_chars follows the new text, other columns go through untouched.
    """
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix to the target weights takes it: 0 to 3 times.

    A null text has size 0 and is as likely taken as any other of its source; a source without words, and an empty table, give no rows.
    """
    return systematic_mix.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens.

    Null and empty texts are one end id; copies are packed each for itself; a text longer than a sequence is cut; an empty table gives no pieces.
    """
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("near-duplicates", drop_near_duplicates), ("secrets", redact_secrets), ("mix", mix_sources), ("packing", pack_sequences)]
#: The stages hold trained models and tokenizers, which SQL cannot express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
