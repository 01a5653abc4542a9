"""Rankings, orders, pages and samples.

``row_number() <= k`` is limited per group before the shuffle too (window group limit), so a group costs at
most k rows per map task however many lines it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partloom.functions import rules
from partloom.functions.money import has_price, lowest_price

CATALOGUE_SORTS = ["global_code", "level1", "level2", "level3", "base_scope"]


def _top(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_ear_lines(lines: DataFrame, k: int = rules.TOP_EAR_LINES) -> DataFrame:
    """Top lines of each file by EAU times own lowest price; demand and market price do not count here."""
    value = F.col("eau") * lowest_price()
    usable = lines.where((F.col("eau") > 0) & has_price()).withColumn("own_ear", value)
    return _top(usable, "file_id", [F.desc("own_ear"), F.col("line_no")], k)


def top_ear_lines_overall(lines: DataFrame, k: int = rules.TOP_EAR_LINES) -> DataFrame:
    value = F.col("eau") * lowest_price()
    usable = lines.where((F.col("eau") > 0) & has_price()).withColumn("own_ear", value)
    return usable.orderBy(F.desc("own_ear"), "file_id", "line_no").limit(k)


def top_quantity_lines(lines: DataFrame, k: int = rules.TOP_EAR_LINES) -> DataFrame:
    """Top lines of each file by plain EAU."""
    usable = lines.where(F.col("eau").isNotNull() & (F.col("eau") != 0))
    return _top(usable, "file_id", [F.desc("eau"), F.col("line_no")], k)


def candidate_in_top(lines: DataFrame, candidates: DataFrame, k: int = rules.TOP_EAR_LINES) -> DataFrame:
    """Whether each candidate line (``item_id``) is among the top EAU lines of its file."""
    top = top_quantity_lines(lines, k).select("item_id", F.lit(True).alias("in_top"))
    return candidates.join(top, "item_id", "left").withColumn("in_top", F.coalesce("in_top", F.lit(False)))


def catalogue_order(references: DataFrame, sort: str | None = None, direction: str = "asc") -> DataFrame:
    """Catalogue in a permitted order, nulls last when ascending; else by base scope and level 2."""
    if sort in CATALOGUE_SORTS:
        c = F.col(sort)
        first = c.desc_nulls_first() if direction == "desc" else c.asc_nulls_last()
        return references.orderBy(first, "id")
    return references.orderBy(F.col("base_scope").asc_nulls_last(), F.col("level2").asc_nulls_last(), "id")


def page(ordered: DataFrame, number: int, size: int = rules.CATALOGUE_PAGE) -> DataFrame:
    """Page ``number`` (from 1) of an ordered frame."""
    return ordered.offset((number - 1) * size).limit(size)


def newest_files(files: DataFrame, number: int = 1, size: int = rules.FILE_PAGE) -> DataFrame:
    return page(files.orderBy(F.desc("created_at"), F.desc("file_id")), number, size)


def first_lines(lines: DataFrame, n: int) -> DataFrame:
    """First ``n`` lines of each file, as shown beside its figures."""
    return _top(lines, "file_id", [F.col("line_no")], n)
