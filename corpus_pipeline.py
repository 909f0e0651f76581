"""The corpus pipeline: documents through quality rules and on; each stage rereads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrane.llm import decontam, mixing, nearcopies, quality, tokenfile
from terrane.llm.common import settle, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return nearcopies.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


#: As in production, but each document is drawn once at most, and the budget is what 80 % of the words allow.
MIX = mixing.Mix(
    domains=(("crawl", "^src[0-9]$", 50), ("books", "^src1[0-4]$", 30)),
    other_domain=("reference", 20),
    languages={"en": 55, "de": 20, "fr": 15, "es": 10},
    other_language=5,
    share=0.8,
    epochs=1,
)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's share of the words is cut to its target weight."""
    return mixing.select_rows(docs, MIX)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids to a binary file, and each document's place in it as read back."""
    return tokenfile.written(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mix_sources),
    ("token-ID output", token_output),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = settle(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
