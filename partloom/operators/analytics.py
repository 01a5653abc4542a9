"""Figures per file from enriched lines.

Everything is an aggregate with map-side combine: no window over a file or an item, so a file or an item
that holds a third of all lines costs no more than its share.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partloom.functions import rules
from partloom.functions.money import has_price, share_band, share_percent
from partloom.functions.scope import normalize_scope
from partloom.functions.text import strip
from partloom.operators.lookup import lookup
from partloom.session import written
from partloom.sources.side_tables import references_by_name

CATEGORIES = ["in_scope_total", "previously_quoted", "meeting_threshold", "crosses_threshold"]


def _zero() -> Column:
    return F.lit(0).cast("decimal(38,2)")


def _ear() -> Column:
    return F.coalesce("ear", _zero())


def effectively_in_scope() -> Column:
    """In scope by its own verdict or because the item was quoted before (no part number guard here)."""
    return (normalize_scope(F.col("scope")) == rules.IN_SCOPE) | F.col("item_quoted")


def meets_threshold() -> Column:
    return F.coalesce(F.col("ear") >= rules.EAR_THRESHOLD, F.lit(False))


def _category_tests() -> list[Column]:
    inside = effectively_in_scope()
    met = inside & meets_threshold()
    return [inside, inside & F.col("item_quoted"), met, met & F.col("active_cross")]


def file_analytics(enriched: DataFrame) -> DataFrame:
    """Count and EAR of the four categories: ``file_id, category, parts, ear``.

    A category counts items whose first line passes its test; its EAR sums all lines of those items that
    pass the test themselves. Both come from one aggregate per (file, item): the tests of the first line
    travel as a bit mask beside the four conditional sums.
    """
    tests = _category_tests()
    mask = sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0))
    per_item = (
        enriched.select(
            "file_id", "item", "line_no", mask.cast("int").alias("mask"), _ear().alias("ear")
        )
        .groupBy("file_id", "item")
        .agg(
            F.min_by("mask", "line_no").alias("first_mask"),
            *[
                F.sum(F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col("ear"))).alias(f"ear{i}")
                for i in range(len(tests))
            ],
        )
    )
    counted = [F.col("first_mask").bitwiseAND(1 << i) != 0 for i in range(len(tests))]
    per_file = per_item.groupBy("file_id").agg(
        *[F.count(F.when(c, 1)).alias(f"n{i}") for i, c in enumerate(counted)],
        *[F.coalesce(F.sum(F.when(c, F.col(f"ear{i}"))), _zero()).alias(f"e{i}") for i, c in enumerate(counted)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("category"),
                F.col(f"n{i}").alias("parts"),
                F.col(f"e{i}").cast("decimal(38,2)").alias("ear"),
            )
            for i, name in enumerate(CATEGORIES)
        ]
    )
    return per_file.select("file_id", F.explode(rows).alias("row")).select("file_id", "row.*")


def unique_item_count(lines: DataFrame) -> DataFrame:
    """Distinct items per file; a null item counts as one."""
    return lines.select("file_id", "item").distinct().groupBy("file_id").agg(F.count("*").alias("items"))


def unique_items_by_scope(lines: DataFrame) -> DataFrame:
    """Items per file and scope of their first line."""
    inside = (normalize_scope(F.col("scope")) == rules.IN_SCOPE).cast("int")
    first = (
        lines.select("file_id", "item", "line_no", inside.alias("inside"))
        .groupBy("file_id", "item")
        .agg(F.min_by("inside", "line_no").alias("inside"))
    )
    label = F.when(F.col("inside") == 1, rules.IN_SCOPE).otherwise(rules.OUT_OF_SCOPE)
    return first.groupBy("file_id", label.alias("scope")).agg(F.count("*").alias("items"))


def ear_by_scope(enriched: DataFrame) -> DataFrame:
    """EAR of all lines per file and own scope (no quote override)."""
    return enriched.groupBy("file_id", normalize_scope(F.col("scope")).alias("scope")).agg(F.sum(_ear()).alias("ear"))


def total_ear(enriched: DataFrame) -> DataFrame:
    return enriched.groupBy("file_id").agg(F.sum(_ear()).alias("ear"))


def threshold_ear(enriched: DataFrame) -> DataFrame:
    """EAR of all lines that are in scope and meet the threshold."""
    met = effectively_in_scope() & meets_threshold()
    return enriched.groupBy("file_id").agg(F.coalesce(F.sum(F.when(met, F.col("ear"))), _zero()).alias("ear"))


def scope_shares(by_scope: DataFrame, value: str) -> DataFrame:
    """Share of each scope in its file; at most two rows per file meet in the window."""
    total = F.sum(value).over(Window.partitionBy("file_id"))
    return by_scope.withColumn("percent", share_percent(F.col(value), total))


def commodity_levels(enriched: DataFrame, references: DataFrame) -> DataFrame:
    """Level 1 per (file, commodity): ``file_id, commodity, level1``.

    Only commodities seen on a first line are looked up; the others stay unknown.
    """
    commodities = enriched.groupBy("file_id", "commodity").agg(
        F.max((F.col("duplication_flag") == rules.FIRST_FLAG)).alias("on_first")
    )
    return _with_level1(commodities, references)


def _with_level1(df: DataFrame, references: DataFrame) -> DataFrame:
    last = references_by_name(references, last=True)
    key = F.when(F.col("on_first"), F.lower(strip(F.col("commodity"))))
    return lookup(df, last, {"name_key": key}, row_id="commodity").select(
        *[c for c in df.columns if c != "on_first"],
        F.coalesce("reference.level1", F.lit(rules.UNKNOWN_LEVEL1)).alias("level1"),
    )


def level1_summary(enriched: DataFrame, references: DataFrame) -> DataFrame:
    """Parts, EAR, in-scope EAR and threshold EAR per file and level 1, with share and band, plus totals.

    What the figures need of a line is written, since it is read twice, for the commodities and for the sums: lines are
    enriched once. The totals row adds the groups up, so a part in two groups counts twice there.
    """
    needed = enriched.select(
        "file_id",
        "commodity",
        strip(F.coalesce("item", F.lit(""))).alias("part"),
        (F.col("duplication_flag") == rules.FIRST_FLAG).alias("on_first"),
        "ear",
        effectively_in_scope().alias("inside"),
    )
    lines = written(needed, "commodity-lines")
    levels = _with_level1(
        lines.groupBy("file_id", "commodity").agg(F.max("on_first").alias("on_first")), references
    ).select(F.col("file_id").alias("lf"), F.col("commodity").alias("lc"), "level1")
    joined = lines.join(levels, (F.col("file_id") == F.col("lf")) & F.col("commodity").eqNullSafe(F.col("lc")), "left")
    # (file, level 1, part) first, so the distinct count of parts is a plain count afterwards.
    per_part = joined.groupBy("file_id", "level1", "part").agg(
        F.sum(_ear()).alias("total_ear"),
        F.sum(F.when(F.col("inside"), _ear())).alias("in_scope_ear"),
        F.sum(F.when(F.col("inside") & meets_threshold(), F.col("ear"))).alias("threshold_ear"),
    )
    sums = [
        F.coalesce(F.sum(c), _zero()).cast("decimal(38,2)").alias(c)
        for c in ("total_ear", "in_scope_ear", "threshold_ear")
    ]
    groups = per_part.groupBy("file_id", "level1").agg(F.count("*").alias("parts"), *sums)
    file_total = F.sum("total_ear").over(Window.partitionBy("file_id"))
    shared = groups.withColumn("percent", share_percent(F.col("total_ear"), file_total))
    totals = groups.groupBy("file_id").agg(F.lit("Total").alias("level1"), F.sum("parts").alias("parts"), *sums)
    return shared.withColumn("band", share_band(F.col("percent"))).unionByName(
        totals.withColumns({"percent": F.lit(100.0), "band": F.lit(None).cast("string")})
    )


def ranked_levels(summary: DataFrame) -> DataFrame:
    """Groups of ``level1_summary`` by total EAR, largest first, without the totals row.

    A file has as many groups as the catalogue has level 1 values.
    """
    order = Window.partitionBy("file_id").orderBy(F.desc("total_ear"), "level1")
    return summary.where(F.col("band").isNotNull()).withColumn("rank", F.row_number().over(order))


def lines_per_commodity(lines: DataFrame) -> DataFrame:
    return lines.groupBy("file_id", "commodity").agg(F.count("*").alias("lines"))


def distinct_commodities(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("commodity").isNotNull()).select("file_id", "commodity").distinct()


def classified_count(lines: DataFrame) -> DataFrame:
    """Lines and classified lines per file."""
    return lines.groupBy("file_id").agg(
        F.count("*").alias("lines"), F.count(F.when(F.col("commodity") != rules.UNKNOWN, 1)).alias("classified")
    )


def coverage_rates(lines: DataFrame, references: DataFrame) -> DataFrame:
    """Embedding coverage of the catalogue; assignment and in-scope rates of each file, in percent."""
    coverage = references.agg(
        F.count(F.when(F.col("embedding").isNotNull(), 1)).alias("part"), F.count("*").alias("whole")
    ).select(F.lit(None).cast("bigint").alias("file_id"), F.lit("embedding_coverage").alias("rate"), "part", "whole")
    assigned = F.col("commodity").isNotNull() & ~F.col("commodity").isin(rules.UNKNOWN, "")
    per_file = lines.groupBy("file_id").agg(
        F.count(F.when(assigned, 1)).alias("assigned"),
        F.count(F.when(F.col("scope") == rules.IN_SCOPE, 1)).alias("inside"),
        F.count("*").alias("whole"),
    )
    rows = F.array(
        F.struct(F.lit("assignment").alias("rate"), F.col("assigned").alias("part")),
        F.struct(F.lit("in_scope").alias("rate"), F.col("inside").alias("part")),
    )
    rates = per_file.select("file_id", "whole", F.explode(rows).alias("r")).select("file_id", "r.rate", "r.part", "whole")
    return coverage.unionByName(rates).withColumn("percent", share_percent(F.col("part"), F.col("whole")))


def export_filter(
    lines: DataFrame,
    scopes: list[str] | None = None,
    commodities: list[str] | None = None,
    data: list[str] | None = None,
) -> DataFrame:
    """Export filters, all optional and combined by AND; a line without scope never passes a scope filter."""
    out = lines
    if scopes:
        out = out.where(F.col("scope").isNotNull() & normalize_scope(F.col("scope")).isin(scopes))
    if commodities:
        out = out.where(F.col("commodity").isin(commodities))
    tests = {
        "with_prices": has_price(),
        "with_cross_refs": F.col("mfg_partno").isNotNull() & (F.col("mfg_partno") != ""),
        "with_demand": F.col("eau") > 0,
    }
    for name in data or []:
        if name in tests:
            out = out.where(tests[name])
    return out


def export_filter_json(lines: DataFrame, filters: str) -> DataFrame:
    """``export_filter`` from its JSON document; unreadable JSON filters nothing."""
    try:
        given = json.loads(filters)
    except ValueError:
        given = {}
    return export_filter(lines, given.get("scope"), given.get("commodity"), given.get("data"))
