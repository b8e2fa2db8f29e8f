"""Documents made ready for training: quality rules, near-duplicates, personal data, source mix, packing.

Each stage takes what its predecessor kept. ``run`` writes every stage's documents as Parquet in the shared folder and reads them back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from reliefgrid.llm.minmax_dedup import one_of_each
from reliefgrid.llm.mixing import mixed_documents
from reliefgrid.llm.packing import pack
from reliefgrid.llm.quality_lines import apply_rules
from reliefgrid.llm.stored import stored
from reliefgrid.llm.surrogates import with_surrogates

SIMILAR_PERCENT = 80
MAX_PASSES = 4.0
TOKENIZER = "byte_bpe_50k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, common lines go from the others."""
    return apply_rules(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return one_of_each(docs, SIMILAR_PERCENT)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates stand for personal data and secrets."""
    return with_surrogates(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come by weight: every document once, those of small sources up to four times."""
    return mixed_documents(docs, budget=None, max_passes=MAX_PASSES)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their place in sequences of 2048 tokens."""
    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("personal data", personal_data),
    ("source mix", source_mix),
    ("packing", packed),
]

ORACLE_SQL = None  # signatures, surrogates and packing have no SQL form; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
