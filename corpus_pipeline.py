"""A training corpus from `documents`: identify, deduplicate, mask, mix, encode.

Every stage works on all rows that the one before it kept and is written as Parquet and read again.
The first four return the columns of `documents`:

1. language_id: documents without a recognisable language go, all others stay as they are.
2. ngram_jaccard: of each group of documents linked by shingles of five words at 0.8, the one with the
   smallest doc_id stays. Documents without words have no group and stay.
3. pii: e-mail and IP addresses, card and phone numbers become <kind>; n_chars follows the text.
4. mixing: each document is there as many times as the mix to target weights takes it.
5. sentencepiece: doc_id, lang, source, n_chars and the ids, with the digest of what they decode to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from holdfast.llm import jaccard, langid, mixing, pii, sentencepieces
from holdfast.llm.common import Scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, Scratch(spark, "pipeline-jaccard"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(docs, Scratch(spark, "pipeline-mixing"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(docs, sentencepieces.model_path(), keep=("lang", "source", "n_chars"))


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("pii", mask_pii),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: SQL expresses neither the classifier nor the random field; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
