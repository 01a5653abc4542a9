"""Prices, quantities and estimated annual revenue (EAR). Money is decimal throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partloom.functions import rules
from partloom.functions.text import bound, is_present, strip

# Prices are kept as written up to ten decimals; passive parts cost fractions of a cent. Only EAR is rounded, once.
PRICE_TYPE = "decimal(28,10)"
EAR_TYPE = "decimal(38,2)"
PRICE_COLUMNS = ["std_cost", "last_purchase_price", "last_po"]


def clean_money(c: Column) -> Column:
    """Number at the head of a money text.

    Commas count as thousands separators even where they are decimal ones ("12,50" is 1250), text without a
    number is 0, null stays null. A number too large for the price type gives null and fails validation.
    """
    # Most cells are plain numbers and need no pattern.
    plain = F.when(F.translate(c, "0123456789.-", "") == "", c.try_cast(PRICE_TYPE))
    kept = F.regexp_replace(c, r"[^0-9.\-]", "")
    head = F.regexp_extract(kept, r"^-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)", 0)
    cleaned = bound(head, lambda h: F.when(h == "", F.lit(0).cast(PRICE_TYPE)).otherwise(h.try_cast(PRICE_TYPE)))
    return F.when(c.isNotNull(), F.coalesce(plain, cleaned))


def money_column(df: DataFrame, name: str) -> Column:
    """``clean_money`` by column type: numbers pass, dates are 0, texts are cleaned."""
    dtype = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dtype, T.NumericType):
        return c.try_cast(PRICE_TYPE)
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.when(c.isNotNull(), F.lit(0).cast(PRICE_TYPE))
    return clean_money(c)


def clean_quantity(c: Column) -> Column:
    """Leading integer of a text ("1,000" is 1, "12.9" is 12, "abc" is 0); blank is null."""
    text = strip(c)
    plain = F.when(F.translate(text, "0123456789", "") == "", text.try_cast("bigint"))
    head = F.regexp_replace(F.regexp_extract(text, r"^[+-]?[0-9]+(?:_[0-9]+)*", 0), "_", "")
    cleaned = bound(head, lambda h: F.when(h == "", F.lit(0).cast("bigint")).otherwise(h.try_cast("bigint")))
    return F.when(is_present(c), F.coalesce(plain, cleaned))


def apply_multiplier(quantity: Column, multiplier: Column) -> Column:
    """Multiplied quantity; null where it overflows, which makes the line invalid instead of ending the run."""
    return F.when(multiplier > 1, F.try_multiply(quantity, multiplier.cast("bigint"))).otherwise(quantity)


def positive(c: Column) -> Column:
    return F.when(c > 0, c)


def lowest_price() -> Column:
    """Smallest positive own price of a line, or null."""
    return F.least(*[positive(F.col(p)) for p in PRICE_COLUMNS])


def has_price(own_price: Column | None = None) -> Column:
    """Whether a line has a positive price; ``own_price`` is its ``lowest_price`` where that was worked out before."""
    if own_price is not None:
        return own_price.isNotNull()
    return F.coalesce(F.col("std_cost") > 0, F.lit(False)) | F.coalesce(
        F.col("last_purchase_price") > 0, F.lit(False)
    ) | F.coalesce(F.col("last_po") > 0, F.lit(False))


def ear(total_demand: Column, min_price: Column, own_price: Column | None = None) -> Column:
    """Quantity times price with fallbacks: EAU then total demand; own lowest price then market minimum."""
    quantity = F.coalesce(positive(F.col("eau")), positive(total_demand))
    price = F.coalesce(lowest_price() if own_price is None else own_price, positive(min_price))
    # Whole and fraction apart: each product is exact, and the whole part does not change the rounding.
    exact, count = price.try_cast(PRICE_TYPE), quantity.cast("decimal(19,0)")
    whole = F.floor(exact).cast("decimal(18,0)")
    part = (exact - whole).cast("decimal(11,10)")
    return F.try_add(count * whole, F.round(count * part, 2)).try_cast(EAR_TYPE)


def ear_uses_fallback(total_demand: Column, min_price: Column, own_price: Column | None = None) -> Column:
    own_quantity = F.coalesce(F.col("eau") > 0, F.lit(False))
    demand = F.coalesce(total_demand > 0, F.lit(False))
    market = F.coalesce(min_price > 0, F.lit(False))
    return (~own_quantity & demand) | ((own_quantity | demand) & ~has_price(own_price) & market)


def ear_status(ear_value: Column, threshold: int = rules.EAR_THRESHOLD) -> Column:
    return (
        F.when(ear_value.isNull(), rules.NO_EAR)
        .when(ear_value >= threshold, rules.EAR_MET)
        .otherwise(rules.EAR_NOT_MET)
    )


def share_percent(part: Column, total: Column) -> Column:
    """Percentage with one digit; 0 when there is no total."""
    share = F.round(F.lit(100.0) * part.cast("double") / total.cast("double"), 1)
    return F.when(total > 0, share).otherwise(F.lit(0.0))


def share_band(percent: Column) -> Column:
    """Band of a share; the upper bound belongs to the lower band."""
    return (
        F.when(percent <= 5, "0-5")
        .when(percent <= 15, "5-15")
        .when(percent <= 30, "15-30")
        .otherwise(">30")
    )
