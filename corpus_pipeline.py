"""A corpus pipeline: toxicity, near-dedup, secrets, mixture and encoding, each stage on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet into the shared folder and
reads it back as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import mixing, near_copies, secrets, sentencepieces, simhash, toxicity
from quire.llm.common import spill, table
from quire.plans.shared import delete_folder, recorded

MIX_FRACTION = 0.9  # of the words that are left; no document is taken twice


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score toxicity.CUT or more go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-copies, linked by sets of five-word shingles with similarity 0.8 or more, the smallest id stays."""
    return simhash.keep_one(docs, found=near_copies.classes(docs))


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets and the parts linked with them are masked, and n_chars follows the text."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of MIX_FRACTION of the words by mixing.WEIGHTS, each document at most once."""
    return mixing.mix(docs, fraction=MIX_FRACTION, max_epochs=1).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its piece_ids."""
    return sentencepieces.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", near_dedup),
    ("secret_scan", scan_secrets),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode_pieces),
]
ORACLE_SQL = None  # the first and last stages aren't SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table. Tables that a stage wrote on its way are deleted when its result, or the next one's, is there."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with recorded() as made:
            docs = spill(stage(spark, docs, sf_dir), name)
        for path in [*before, *made[:-1]]:
            delete_folder(spark, path)
        before = made[-1:]
    return docs
