"""A training-corpus pipeline over `documents`: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vaultspark.llm import bpe, decontaminate, langid, pii, simhash
from vaultspark.llm.common import materialize, release, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language; `und` ones go."""
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document of smallest id."""
    return simhash.drop_near_duplicates(docs)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item, edited or not."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data in its text masked and n_chars brought into line."""
    return pii.redact_documents(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its token ids; `decoded_sha256` is of the bytes that the ids decode to."""
    return bpe.tokenize_documents(docs)


STAGES = [
    ("language", identify_language),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_copies),
    ("personal data", redact_personal_data),
    ("tokens", encode_tokens),
]

#: Byte-level BPE, the random field and the trained language model are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the `documents` of sf_dir; each result but the last is written and read again, then removed."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs, path = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        release(spark, *before)
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
