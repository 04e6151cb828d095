"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import CHAT_SQL, PROBE, chat_digests, format_chats
from .common import read
from .kdtree import TOP_SQL, top_products
from .mixing import MIX_SQL, mix
from .neighbours import nearest
from .packing import pack
from .periodic import periodic_runs, planted, run_digests
from .quality import quality
from .secrets import SECRETS_SQL, secret_scan
from .simhash import near_duplicates
from .spelling import planted_runs, variants
from .substrings import repeated_units
from .token_counts import token_counts
from .urls import RULES, judge_urls, labels_of_pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return wrap


@query("op10_token_counts")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts(read(spark, sf, "documents"), "piece_bpe_32k.model", 4096)


@query("op6_pack")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return pack(read(spark, sf, "documents"), 1024, "byte_bpe_50k.json", 2)


@query("op7_mix", MIX_SQL)
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return mix(read(spark, sf, "documents"), (5, 2, 1), 1.5, 2.0)


@query("op3_secret_scan", SECRETS_SQL)
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan(read(spark, sf, "documents"))


@query("op4_simhash")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(read(spark, sf, "documents"), 4, 4, 42)


@query("op5_quality")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return quality(read(spark, sf, "documents"))


@query("op9_nearest")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return nearest(read(spark, sf, "embeddings"), 100, 10)


@query("op2_chat", CHAT_SQL)
def op2(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return chat_digests(format_chats(rows.unionByName(probe)))


@query("op8_urls")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    pages = read(spark, sf, "pages").select("page_id", "url")
    return judge_urls(pages, labels_of_pages(pages, read(spark, sf, "labels")), RULES)


@query("op1_substrings")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return repeated_units(read(spark, sf, "documents"))


@query("op13_spelling")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return variants(planted_runs(read(spark, sf, "documents")), 6, 5, 5)


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return run_digests(periodic_runs(planted(read(spark, sf, "documents")), 12))


@query("op11_top_products", TOP_SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return top_products(read(spark, sf, "embeddings"), 20, 20, 64.0)
