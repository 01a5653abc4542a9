"""Enrichment of classified lines to the result columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.functions import rules
from partloom.functions.money import ear, ear_status, ear_uses_fallback, lowest_price
from partloom.functions.scope import override
from partloom.operators.lookup import item_facts, quote_columns, repeats_mpn, with_cross, with_item_facts
from partloom.sources.side_tables import crosses_by_mpn, demand_by_item, latest_quotes


def enrich(lines: DataFrame, quotes: DataFrame, aml: DataFrame, crosses: DataFrame | None = None) -> DataFrame:
    """Lines with duplicate flag, quote, cross, demand, price, EAR and final scope.

    Without ``crosses`` the lines must already carry the cross columns, as classified lines do.

    ``lines`` carries the file options ``demand_lookup`` and ``grade``. All lookups by item are made on the
    distinct items, so the lines themselves are shuffled once for the part numbers and once for the items. What the
    figures need of prices and part number is worked out before, so that a run that shows neither shuffles neither.
    """
    known = lines.withColumns(
        {"own_price": lowest_price(), "repeats_mpn": repeats_mpn(F.col("item"), F.col("mfg_partno"))}
    )
    if crosses is not None:
        known = with_cross(known, crosses_by_mpn(crosses))
    joined = with_item_facts(known, item_facts(lines, latest_quotes(quotes), demand_by_item(aml)))
    demand = F.when(F.col("demand_lookup"), F.col("total_demand"))
    priced = joined.withColumn("total_demand", demand).withColumns(
        {
            "duplication_flag": F.when(
                F.col("line_no") == F.col("first_line_no"), rules.FIRST_FLAG
            ).otherwise(rules.REPEAT_FLAG),
            "ear": ear(F.col("total_demand"), F.col("min_price"), F.col("own_price")),
            "ear_fallback": ear_uses_fallback(F.col("total_demand"), F.col("min_price"), F.col("own_price")),
            **quote_columns(F.col("item"), F.col("mfg_partno"), F.col("item_quoted"), F.col("repeats_mpn")),
        }
    )
    quoted = F.coalesce(F.col("previously_quoted") == rules.QUOTED, F.lit(False))
    return priced.withColumns(
        {"ear_status": ear_status(F.col("ear")), "final_scope": override(F.col("scope"), quoted)}
    ).drop("first_line_no", "log_date", "quote_number", "quote_mpn", "own_price", "repeats_mpn")
