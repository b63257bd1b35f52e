"""A training-data pipeline over the table documents: language ID, near-dedup, decontamination, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logloom.llm import decontaminate, language_id, mixing, near_dedup, packing
from logloom.llm.common import materialise, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that read like one of the languages which the labelled rows teach; others go, as do those without letters.

    A text goes if it needs more than 2.2 times the phrases of unseen labelled texts, and 6 more.  Without labelled rows all stay.
    """
    return language_id.known_language(docs, language_id.fit(docs), excess=2.2, slack=6.0)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingle sets are 0.8 alike or more."""
    return near_dedup.drop_near_duplicates(docs, k=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in 13-word passages of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), max_coverage=0.05, action="drop")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents are left out, or come twice."""
    return mixing.mix(docs, weights=(3, 1, 2), total=1.5, cap=2.0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids."""
    return packing.pack(docs)


STAGES = [("language_id", language), ("near_dedup", near_duplicates), ("decontaminate", benchmark), ("mix", mix), ("pack", pack)]

#: Automata, minwise trees, the cube method and packing aren't SQL; each stage is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs)
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
