"""Corpus pipeline: toxic documents go, poor ones go, one of each group of near
duplicates stays, secrets are masked, and what is left is packed into sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as
Parquet and read again as the next one's ``docs``; all but the last return the columns
of ``documents``.  Rows with null or repeated ids and null or empty texts follow the
operators' docstrings; an empty table gives no rows at every stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recsmith.llm.common import prepare, table
from recsmith.llm.packing import pack_documents
from recsmith.llm.quality import fit_quality, quality_kept
from recsmith.llm.secrets import fit_findings, mask_secrets
from recsmith.llm.simhash import near_dedup
from recsmith.llm.toxicity import fit_lexicon, toxicity_score
from recsmith.session import ensure_checkpoint_dir

TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon scores below the threshold."""
    lexicon = fit_lexicon(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity_score(F.col("text"), lexicon) < TOXIC)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality_kept(F.col("text"), model))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class (3-word shingles, 2 bits)."""
    prepare(spark)
    return near_dedup(docs, shingle=3, max_bits=2, seed=42)


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets replaced by a mark; ``n_chars`` follows the new text."""
    prepare(spark)
    out = docs.withColumn("text", mask_secrets(F.col("text"), fit_findings()))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens placed in sequences."""
    prepare(spark)
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), size=1024, end_id=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_poor),
    ("SimHash near-dedup", drop_near_duplicates),
    ("secret scans", mask),
    ("best-fit packing", pack_sequences),
]

#: Learnt scores and tokenisation have no SQL form; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between them Parquet in the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    base = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{base}/{k}")
        docs = spark.read.parquet(path)
    return docs
