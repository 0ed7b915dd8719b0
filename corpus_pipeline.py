"""The training-data pipeline over `documents`, and the registered queries of its operators.

Every stage is written as Parquet and read again as the next one's documents. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ladderline.llm import mixing, packing, pii, quality, simhash
from ladderline.llm.common import read_table
from ladderline.llm.queries import ORACLE, QUERIES, tokenizer_path
from ladderline.session import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.accepted(docs, quality.trusted_documents(read_table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes pseudonyms."""
    return pii.pseudonymized_documents(docs)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents once per epoch that the mixture takes; one at a source's cut gives its first words."""
    return mixing.mixed(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents, as packing.pack returns them."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_duplicates),
    ("pseudonyms", personal_data),
    ("mixing", source_mixture),
    ("packing", packed_sequences),
]

# hashed n-grams, SimHash and the vocabulary have no counterpart in DuckDB SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the `documents` table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES["pipeline"] = run
