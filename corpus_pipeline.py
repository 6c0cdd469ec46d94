"""A training-data pipeline over ``documents``: five stages, each written as
Parquet and read again as the next one's input.

1. quality classifier: documents that the language model finds unlike the
   trusted ones (``labels.quality = 1``) go;
2. toxicity: documents predicted toxic go;
3. n-gram Jaccard join: one document of each group of near duplicates stays;
4. mixing sources to target weights: documents repeat or go so that sources
   meet their targets;
5. BPE encoding and decoding: token counts and digests of ids and text.

All but the last return the columns of ``documents``. Nulls, empty and very
long texts, ties and repeated rows have the results that the operators'
docstrings define: an empty text is kept by 1, 2 and 3, and by 4 as often as
its source repeats; an empty table gives an empty result.

The models of stages 1 and 2 can't be written in SQL, so there is no oracle;
tests compare every stage with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from martlet.llm import bpe, jaccard_join, kneser_ney, mixing, toxicity
from martlet.llm.common import materialise, read_table, ship_package
from martlet.llm.queries import vocabulary


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    trusted = read_table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return kneser_ney.kept_documents(docs, trusted)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return toxicity.clean_documents(docs, read_table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return jaccard_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return bpe.digests(docs, vocabulary(), keep=("doc_id", "lang", "source"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("toxicity", without_toxic),
    ("n-gram Jaccard join", without_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: No SQL can express the trained models of the first two stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES, 1):
        docs = materialise(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
