"""From documents to packed training sequences: five stages, each written and read again.

1. ``language``: documents whose language is not accepted go;
2. ``near_copies``: one document of each group of near copies stays (five-word shingles, Jaccard of 0.8 or more);
3. ``repeats``: passages of 50 words or more that repeat an earlier place are cut;
4. ``mix``: sources are mixed to their target weights, as copies and cuts of documents;
5. ``pack``: token sequences of at most 2048, packed best-fit.

Each function takes (spark, docs, sf_dir) and works on all of ``docs``; all but the last return the columns
of documents. An empty table gives an empty result in every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vectables.llm import stages
from vectables.llm.store import Workspace


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.keep_known_languages(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.keep_one_of_each_group(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.cut_repeated_passages(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.mix_sources(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.pack_sequences(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_copies", near_copies),
    ("repeats", repeats),
    ("mix", mix),
    ("pack", pack),
]

#: language models, tokenizers and pseudorandom mixing have no SQL form; tests compare each stage with brute force
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written to the shared folder and read again."""
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = space.save(stage(spark, docs, sf_dir), name)
    return docs
