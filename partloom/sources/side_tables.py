"""Side tables reduced to one row per lookup key.

Every reduction is an aggregation with map-side combine, so a key holding a large part of a side table is
already small when it is shuffled. Filters and column choices sit on the scan and are pushed down.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.functions import rules
from partloom.functions.money import PRICE_TYPE
from partloom.functions.text import is_present, squeeze_key

CROSS_COLUMNS = ["cross_ref_mpn", "supplier_pn", "house_mpn", "house_cost", "cross_ref_mfg"]
# Columns of the opportunity lookup.
OPPORTUNITY_COLUMNS = [
    "opportunity_number",
    "opportunity_name",
    "customer",
    "probability",
    "targeted_quote_deadline",
    "product_application",
    "bu",
    "stage",
    "ear",
    "site_1",
    "bd_owner",
    "sop_date",
]


def usable_crosses(crosses: DataFrame, grade: str) -> DataFrame:
    """Distinct cross rows of a grade that name a part number."""
    return (
        crosses.where(F.col("cross_ref_mpn").isNotNull() & (F.col("component_grade") == grade))
        .select(*CROSS_COLUMNS)
        .distinct()
    )


def crosses_by_mpn(crosses: DataFrame) -> DataFrame:
    """One row per (part number, grade) with everything the lines look up.

    ``has_cross`` any status; ``active_cross`` status exactly ACTIVE with a house part; ``cross_mpn`` house
    part of rows whose trimmed upper status is ACTIVE. The largest house part stands for several.
    """
    house = F.col("house_mpn")
    active_loose = F.upper(F.trim("status")) == rules.ACTIVE_STATUS
    active_exact = (F.col("status") == rules.ACTIVE_STATUS) & house.isNotNull()
    return (
        crosses.where(F.col("cross_ref_mpn").isNotNull())
        .groupBy("cross_ref_mpn", "component_grade")
        .agg(
            F.lit(True).alias("has_cross"),
            F.max(F.coalesce(active_exact, F.lit(False))).alias("active_cross"),
            F.max(F.when(active_loose, house)).alias("cross_mpn"),
        )
    )


def crosses_by_status(crosses: DataFrame) -> DataFrame:
    """The largest house part per (part number, grade, status): all that ``crosses_by_mpn`` needs, in fewer rows."""
    named = crosses.where(F.col("cross_ref_mpn").isNotNull())
    return named.groupBy("cross_ref_mpn", "component_grade", "status").agg(F.max("house_mpn").alias("house_mpn"))


def cheapest_crosses(crosses: DataFrame, grade: str) -> DataFrame:
    """Cheapest row per (part number, supplier part, manufacturer); no cost counts as cheapest."""
    cost = F.coalesce(F.col("house_cost"), F.lit(-(10**13)).cast(PRICE_TYPE))
    best = F.min(F.struct(cost.alias("sort_cost"), F.col("house_mpn"), F.col("house_cost"))).alias("best")
    return (
        crosses.where((F.col("component_grade") == grade) & is_present(F.col("house_mpn")))
        .where(F.col("cross_ref_mpn").isNotNull())
        .groupBy("cross_ref_mpn", "supplier_pn", "cross_ref_mfg")
        .agg(best)
        .select(
            "cross_ref_mpn",
            "supplier_pn",
            F.col("best.house_mpn").alias("house_mpn"),
            F.col("best.house_cost").alias("house_cost"),
            "cross_ref_mfg",
        )
    )


def best_cross(crosses: DataFrame, grade: str) -> DataFrame:
    """One of the cheapest rows per part number: the first by supplier part and manufacturer."""
    pick = F.struct("supplier_pn", "cross_ref_mfg", "house_mpn", "house_cost")
    return (
        cheapest_crosses(crosses, grade)
        .groupBy("cross_ref_mpn")
        .agg(F.min(pick).alias("pick"))
        .select("cross_ref_mpn", "pick.*")
    )


def best_cross_by_grade(crosses: DataFrame) -> DataFrame:
    """As ``best_cross``, one row per part number and grade."""
    cost = F.coalesce(F.col("house_cost"), F.lit(-(10**13)).cast(PRICE_TYPE))
    cheapest = (
        crosses.where(is_present(F.col("house_mpn")) & F.col("cross_ref_mpn").isNotNull() & F.col("component_grade").isNotNull())
        .groupBy("cross_ref_mpn", "component_grade", "supplier_pn", "cross_ref_mfg")
        .agg(F.min(F.struct(cost.alias("sort_cost"), F.col("house_mpn"), F.col("house_cost"))).alias("best"))
    )
    pick = F.struct("supplier_pn", "cross_ref_mfg", F.col("best.house_mpn").alias("house_mpn"), F.col("best.house_cost").alias("house_cost"))
    return cheapest.groupBy("cross_ref_mpn", "component_grade").agg(F.min(pick).alias("pick")).select("cross_ref_mpn", "component_grade", "pick.*")


def latest_quotes(quotes: DataFrame) -> DataFrame:
    """Latest quote per item; equal dates are decided by quote number, then part."""
    last = F.max(F.struct("log_date", "quote_number", "quote_mpn")).alias("last")
    return (
        quotes.where(F.col("item").isNotNull())
        .groupBy("item")
        .agg(last)
        .select("item", "last.log_date", "last.quote_number", "last.quote_mpn")
    )


def demand_by_item(aml: DataFrame) -> DataFrame:
    """Total demand and lowest price per item, nulls ignored."""
    return aml.where(F.col("item").isNotNull()).groupBy("item").agg(
        F.max("total_demand").alias("total_demand"), F.min("min_price").alias("min_price")
    )


def manufacturer_names(mapping: DataFrame) -> DataFrame:
    """One standard name per alias; the last mapping wins."""
    order = "id" if "id" in mapping.columns else "standardized_name"
    return mapping.groupBy("original_name").agg(F.max_by("standardized_name", order).alias("standardized_name"))


def opportunity_lookup(requests: DataFrame, opportunities: DataFrame, service_group: str) -> DataFrame:
    """Opportunity of every requested number within a service group, one row per number."""
    rest = [c for c in OPPORTUNITY_COLUMNS if c != "opportunity_number"]
    found = (
        opportunities.where(F.col("service_group") == service_group)
        .groupBy("opportunity_number")
        .agg(F.min(F.struct(*rest)).alias("row"))
        .select("opportunity_number", "row.*")
    )
    wanted = requests.where(is_present(F.col("opportunity_number"))).select("opportunity_number").distinct()
    return wanted.join(found, "opportunity_number")


def references_by_name(references: DataFrame, column: str = "level3", last: bool = False) -> DataFrame:
    """One catalogue row per lower-case name: the lowest id, or the highest with ``last``."""
    pick = F.max_by if last else F.min_by
    row = F.struct("id", "level1", "level3", "base_scope", "auto_scope")
    return (
        references.where(F.col(column).isNotNull())
        .groupBy(F.lower(column).alias("name_key"))
        .agg(pick(row, F.col("id")).alias("reference"))
    )


def catalogue_values(references: DataFrame, column: str) -> DataFrame:
    """Distinct values of a catalogue column in comparison form."""
    return references.where(F.col(column).isNotNull()).select(squeeze_key(F.col(column)).alias("value_key")).distinct()


def key_hygiene(df: DataFrame, column: str) -> DataFrame:
    """Distinct present keys of a column."""
    return df.select(column).where(is_present(F.col(column))).distinct()


