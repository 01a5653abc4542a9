"""One query per operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from partloom.llm import alignment, bytetrees, mixing, personal, pieces, products, quality, sketching, snapshots, templates, toxicity, urllists, whitening
from partloom.llm.common import table
from partloom.llm.sql import ABLATION, MIXING, PRODUCTS, QUALITY, SNAPSHOTS, URLLISTS

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judge(quality.ledger(table(spark, sf_dir, "documents")), "web-2")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_bits"
    )


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the newest policy costs, counted over the ledger of all documents."""
    return quality.ablate(quality.ledger(table(spark, sf_dir, "documents")), "web-2")


def op2_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketching.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytetrees.identify(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages table has no fetch day: one is derived from the page id."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 7919, F.lit(365)).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", "url", day.alias("fetched_on"))


def list_log(pages: DataFrame) -> DataFrame:
    """Dated list rows for the hosts of the pages, derived from digests of their names.

    A site (host without www, m or blog) may be added as a domain, removed and added again; a host may be added alone.
    """
    digit = lambda at, n=1: F.conv(F.substring("h", at, n), 16, 10).cast("int")
    start = F.lit("2024-01-01").cast("date")
    hosts = pages.select(urllists.host_of(F.col("url")).alias("host")).where("host IS NOT NULL").distinct()
    sites = hosts.select(F.regexp_replace("host", "^(www|m|blog)[.]", "").alias("entry")).distinct().withColumn("h", F.md5("entry"))
    first = F.pmod(digit(3, 4), F.lit(365))
    kind = lambda name: F.lit(name).alias("kind")
    of_site = F.when(digit(7) < 8, F.lit("spam")).otherwise(F.lit("adult")).alias("list")
    listed = sites.where(digit(1, 2) < 96)
    row = lambda rows, action, day: rows.select(of_site, kind("domain"), "entry", F.lit(action).alias("action"), F.date_add(start, day).alias("dated"))
    alone = hosts.select(F.col("host").alias("entry"), F.md5("host").alias("h")).where(digit(1, 2) < 48)
    return (
        row(listed, "add", first)
        .union(row(listed.where(digit(10) < 10), "remove", first + 1 + F.pmod(digit(8, 2), F.lit(120))))
        .union(row(listed.where(digit(11) < 4), "add", first + 200))
        .union(alone.select(F.lit("phish").alias("list"), kind("host"), "entry", F.lit("add").alias("action"), F.date_add(start, first).alias("dated")))
    )


def op6_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urllists.filtered(captures(spark, sf_dir), list_log(table(spark, sf_dir, "pages")))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = alignment.line_dedup(table(spark, sf_dir, "documents"))
    return changed.select("doc_id", "text", F.col("__deleted").alias("n_deleted"), F.col("__blocks").alias("n_blocks"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.find_personal_data(table(spark, sf_dir, "documents"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.chat(table(spark, sf_dir, "conversations"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op11_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.top_products(table(spark, sf_dir, "embeddings"))


def op12_token_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.aligned(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    fn.__name__: fn
    for fn in (
        op1_quality_rules,
        op2_template_leaks,
        op3_near_duplicates,
        op4_language,
        op5_toxicity,
        op6_url_lists,
        op7_line_dedup,
        op8_personal_data,
        op9_chat,
        op10_mixing,
        op11_top_products,
        op12_token_groups,
        op13_whitening,
        quality_ablation,
    )
}

ORACLES: dict[str, str] = {
    "op1_quality_rules": QUALITY,
    "quality_ablation": ABLATION,
    "op6_url_lists": URLLISTS,
    "op9_chat": SNAPSHOTS,
    "op10_mixing": MIXING,
    "op11_top_products": PRODUCTS,
}
