"""The registered queries of this subpackage, with production parameters over
whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlet.llm import (bpe, chunk_recipes, html_consensus, importance, jaccard_join, kneser_ney, mixing, quality_rules,
                         spelling, token_counts, toxicity, url_templates, vptree)
from martlet.llm.common import read_table, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def deco(fn):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = query
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


@_register("op1_quality_rules", quality_rules.JUDGE_SQL)
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.judge(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       "base_failed", "kept", "pm_symbols", "pm_dup_lines", "pm_repeats", "pm_shouting")


@_register("op5_mix_sources", mixing.MIX_SIZES_SQL)
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(read_table(spark, sf_dir, "documents"))


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@_register("op3_bpe")
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read_table(spark, sf_dir, "documents"), vocabulary())


@_register("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = token_counts.zipf_scores(vocabulary("byte_bpe_50k.tiktoken"))
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), scores)


@_register("op10_quality_model")
def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = read_table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return kneser_ney.judge(read_table(spark, sf_dir, "documents"), trusted)


@_register("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@_register("op9_jaccard_join")
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


@_register("op7_nearest", vptree.NEAREST_SQL)
def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    return vptree.nearest(rows, rows.where("vec_id % 100 = 0"))


@_register("op2_url_templates")
def op2_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page shows the document whose id is the last number of its path, so
    the document's quality label is the page's."""
    labels = (read_table(spark, sf_dir, "labels").where("quality IS NOT NULL")
              .groupBy(F.col("doc_id").alias("shown")).agg(F.min("quality").alias("label")))
    shown = F.try_to_number(F.nullif(F.regexp_extract(url_templates.url_path(F.col("url")), r"([0-9]{1,18})[^0-9]*$", 1),
                                     F.lit("")), F.lit("999999999999999999")).cast("bigint")
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", shown.alias("shown"))
    return url_templates.judge(pages.join(labels, "shown", "left"))


@_register("op6_main_text")
def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_consensus.extract(read_table(spark, sf_dir, "pages"))


@_register("op13_chunk_recipes", chunk_recipes.DEDUP_SQL)
def op13_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_recipes.classes(read_table(spark, sf_dir, "documents"))


@_register("op11_importance", importance.RESAMPLE_SQL)
def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@_register("op12_spelling", spelling.VARIANT_SQL)
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read_table(spark, sf_dir, "documents"))
