"""A training-data pipeline over ``documents``: five stages, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir). Its rows are written as Parquet to the
shared folder and read again as the next one's documents. All but the last
return the columns of ``documents``; the last gives the packed pieces.

Null texts are empty ones, and quality decides on them like on any other.
Repeated rows are exact copies. An empty table passes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import exact_dedup, mixing, packing, quality, simhash
from quillspark.llm.queries import SEQUENCE, domains
from quillspark.llm.tables import prepared, read
from quillspark.session import written

#: Share of the tokens that the mixture takes; every document at most once.
MIX_SHARE = 0.9


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the best grade is at least ``quality.TAIL``."""
    prepared(spark)
    return quality.keep(docs, quality.fit(docs, quality.grades(read(spark, sf_dir, "labels"))))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that of the smallest doc_id."""
    prepared(spark)
    return exact_dedup.drop_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts of five-word Jaccard 0.8 or more, that of the smallest doc_id."""
    prepared(spark)
    return simhash.drop_near_duplicates(docs)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a mixture in which the domains, and their languages and sources, weigh alike."""
    prepared(spark)
    return mixing.select(docs, domains(docs), {}, MIX_SHARE, 1, 20240521).select("doc.*")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents and their places in sequences."""
    prepared(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 1, SEQUENCE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_classifier),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("mixture", source_mixture),
    ("packing", sequences),
]

#: SQL has no equal for the classifier, SimHash and the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": lambda spark, root: run(spark, root)}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
