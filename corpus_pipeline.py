"""A corpus pipeline: documents without toxic ones, exact and near copies, mixed to target weights and packed.

Each stage is a function of (spark, docs, sf_dir) and calls one operator of
harrow.llm.  ``run`` writes each stage's result into the shared checkpoint
folder and gives what it reads back to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from harrow.llm import exact_dedup, mixing, packing, simhash, toxicity
from harrow.llm.common import materialize, table
from harrow.llm.queries import TOKENIZER, toxicity_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; every text is scored, null and empty ones too."""
    scored = toxicity.score(docs, toxicity_model(spark, sf_dir), out="__toxicity")
    return scored.where(scored["__toxicity"] < toxicity.THRESHOLD).drop("__toxicity")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal after lower-casing A-Z."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by fingerprints of 4-word shingles that differ in at most 4 bits."""
    return simhash.simhash_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for, in random order."""
    return mixing.mix(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 1024 tokens."""
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: zstandard dictionaries, XXH64 and tokenizers are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
