"""The corpus queries and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .decontaminate import LEAKS_SQL, leaked_documents
from .hosts import JUDGE_SQL, judge_pages, numbered_outcomes
from .html import extract
from .mixing import MIX_SQL, mix_documents
from .neardup import GROUPS_SQL, group_documents
from .quality import score_documents as score_quality
from .shards import shard_documents
from .suffix import strip_documents
from .topk import TOP_SQL, top_k
from .toxicity import score_documents


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(read_table(spark, sf_dir, "documents"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_documents(read_table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"))


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes are the labels of the documents that the pages show, by the
    number in their urls."""
    pages, labels = read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "labels")
    return judge_pages(pages, numbered_outcomes(pages, labels))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strip_documents(read_table(spark, sf_dir, "documents"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_near_duplicates, op3_quality, op4_toxicity, op5_decontaminate, op6_top_k, op7_shard, op8_url_filter, op9_repeated_passages, op10_main_text)}
ORACLE_SQL = {"op1_mix_sources": MIX_SQL, "op2_near_duplicates": GROUPS_SQL, "op5_decontaminate": LEAKS_SQL, "op6_top_k": TOP_SQL, "op8_url_filter": JUDGE_SQL}
