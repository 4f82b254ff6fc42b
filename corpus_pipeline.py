"""The training-data pipeline: language, near-duplicates, secrets, mix, tokens.

Each stage takes (spark, docs, sf_dir) and all documents its predecessor kept; all but the last return the columns
of ``documents``. ``run`` writes each stage's result to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaygrid.llm import bpe, language, minhash, mixing, secrets
from assaygrid.runtime import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence; without letters, or between languages, they go."""
    told = language.identify(docs, language.fit(language.learnable(docs)))
    lang, score = told.columns[-2:]
    return told.filter((F.col(lang) != "und") & (F.col(score) >= language.MIN_CONFIDENCE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies: 0.8 of the shingles of five words in common."""
    return minhash.deduplicate(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in the place of each secret."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, the token ids of each document, their number and checksums."""
    import public_tokenizers

    out = bpe.tokenize(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "source", "ids", *bpe.digests(out))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mix", mix),
    ("tokens", tokens),
]

# A network's decisions and signatures cannot be put in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
