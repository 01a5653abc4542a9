"""Lookups of lines in side tables.

Every side is reduced to one row per key before it is joined, so a join never multiplies lines. No side is
broadcast by hint: Spark broadcasts what its size checks allow and otherwise shuffles, where the AQE skew
join splits hot keys. Lines without a key cannot match; their null keys are scattered so that they do not
meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from partloom.functions import rules
from partloom.functions.scope import resolve_scope
from partloom.functions.text import is_present, lookup_key, strip
from partloom.sources.side_tables import references_by_name

NULL_KEY_SPREAD = 1024
_NO_KEY = "\x00no key "
QUOTE_ANSWERS = ["log_date", "quote_number", "quote_mpn"]


def lookup(df: DataFrame, side: DataFrame, keys: dict[str, Column], row_id: str | None = "item_id") -> DataFrame:
    """Left join on computed keys against a side that is unique in the named key columns.

    ``keys`` maps each key column of ``side`` to the expression looked up. The first key decides whether a row
    can match. Where a text is null, a marker with a spread number, which no side row carries, stands for it; the side
    is then joined on its own key columns, and one that was just aggregated by them is not shuffled again. For keys of
    other types the number is a further join key. It is always 0 for a side row, but computed from its key: as a
    constant the optimizer would take it out of the join keys, and the null keys would meet again.
    """
    first, value = next(iter(keys.items()))
    names = [f"_k_{k}" for k in keys]
    spread = F.pmod(F.xxhash64(row_id), F.lit(NULL_KEY_SPREAD)).cast("int") if row_id else F.lit(1)
    left = df.withColumns({f"_k_{k}": v for k, v in keys.items()})
    right = side.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    if isinstance(left.schema[f"_k_{first}"].dataType, StringType):
        marked = F.coalesce(f"_k_{first}", F.concat(F.lit(_NO_KEY), spread.cast("string")))
        return left.withColumn(f"_k_{first}", marked).join(right, names, "left").drop(*names)
    left = left.withColumn("_spread", F.when(F.col(f"_k_{first}").isNull(), spread + 1).otherwise(0))
    right = right.withColumn("_spread", F.pmod(F.hash(f"_k_{first}"), F.lit(1)))
    return left.join(right, [*names, "_spread"], "left").drop("_spread", *names)


def with_cross(lines: DataFrame, crosses: DataFrame) -> DataFrame:
    """Cross columns of each line by (part number, grade of its file); ``crosses`` from ``crosses_by_mpn``."""
    mpn = F.when(is_present(F.col("mfg_partno")), F.col("mfg_partno"))
    side = crosses.withColumnRenamed("cross_ref_mpn", "mpn_key").withColumnRenamed("component_grade", "grade_key")
    joined = lookup(lines, side, {"mpn_key": mpn, "grade_key": F.col("grade")})
    return joined.withColumns(
        {
            "has_cross": F.coalesce("has_cross", F.lit(False)),
            "active_cross": F.coalesce("active_cross", F.lit(False)),
        }
    )


def with_commodity(
    df: DataFrame, references: DataFrame, name: Column, by: Column | None = None, row_id: str = "item_id"
) -> DataFrame:
    """Catalogue row of a commodity name as struct ``reference`` (null when unknown).

    ``by`` tells per row whether the name is a level 3 or a global code; without it all are level 3.
    """
    level3 = references_by_name(references).select("name_key", "reference", F.lit("level3").alias("name_kind"))
    if by is None:
        return lookup(df, level3.drop("name_kind"), {"name_key": lookup_key(name)}, row_id)
    codes = references_by_name(references, "global_code").select(
        "name_key", "reference", F.lit("global_code").alias("name_kind")
    )
    return lookup(df, level3.unionByName(codes), {"name_key": lookup_key(name), "name_kind": by}, row_id)


def reference_scope(auto_mode: Column) -> Column:
    """Scope by the looked-up catalogue row."""
    return resolve_scope(F.col("reference.base_scope"), F.col("reference.auto_scope"), auto_mode)


def commodity_batch(names: DataFrame, references: DataFrame, column: str = "level3") -> DataFrame:
    """Distinct names with their catalogue row (highest id) and their base scope.

    The base scope compares without stripping, as this batch form always did.
    """
    last = references_by_name(references, column, last=True)
    wanted = names.where(is_present(F.col("name"))).select("name").distinct()
    base_in = F.coalesce(F.lower("reference.base_scope") == "in scope", F.lit(False))
    return lookup(wanted, last, {"name_key": lookup_key(F.col("name"))}, row_id="name").select(
        "name", "reference", F.when(base_in, rules.IN_SCOPE).otherwise(rules.OUT_OF_SCOPE).alias("scope")
    )


def repeats_mpn(item: Column, mpn: Column) -> Column:
    """Whether an item merely repeats the part number."""
    return F.coalesce(is_present(mpn) & (item == mpn), F.lit(False))


def quote_columns(item: Column, mpn: Column, quoted: Column | None = None, repeats: Column | None = None) -> dict[str, Column]:
    """Quote answer of a line after the quotes were joined by item.

    A blank item has no answer; an item that merely repeats the part number is never looked up. ``quoted`` tells
    whether a quote was found; a quote counts whether or not it is dated. Without it the date tells. ``repeats`` is
    ``repeats_mpn`` where that was worked out before.
    """
    found = F.col("log_date").isNotNull() if quoted is None else F.coalesce(quoted, F.lit(False))
    usable = found & ~(repeats_mpn(item, mpn) if repeats is None else repeats)
    return {
        "previously_quoted": F.when(is_present(item), F.when(usable, rules.QUOTED).otherwise(rules.NOT_QUOTED)),
        "quote_date": F.when(usable, F.col("log_date")),
        "previous_quote_number": F.when(usable, F.col("quote_number")),
        "quoted_mpn": F.when(usable, F.col("quote_mpn")),
    }


def item_answers(quotes: DataFrame, demand: DataFrame) -> DataFrame:
    """One row per stripped item: its demand, and the quotes of all items that differ from it by white space only.

    Quotes are looked up by the item as it stands and demand by the stripped item; kept under one key, both take a
    single lookup. A blank item has no demand. Every quote column has a list of its own, so that a run reads only
    those it shows.
    """
    quoted = quotes.groupBy(strip(F.col("item")).alias("item_key")).agg(
        F.collect_list("item").alias("quoted_items"), *[F.collect_list(F.struct("item", c)).alias(c) for c in QUOTE_ANSWERS]
    )
    return quoted.join(demand.where(F.col("item") != "").withColumnRenamed("item", "item_key"), "item_key", "full")


def item_facts(lines: DataFrame, quotes: DataFrame, demand: DataFrame) -> DataFrame:
    """One row per (file, item): its first line number, its latest quote, its demand and market price.

    Lookups by item run once per distinct item instead of once per line. The first line comes from a
    partial hash aggregate, so an item on a third of all lines never gathers in one task. Line numbers are
    unique within a file; that of an item's only line is left out (null), since the line carries it.
    """
    items = lines.groupBy("file_id", "item").agg(F.min("line_no").alias("first"), F.count("*").alias("n"))
    items = items.select("file_id", "item", F.when(F.col("n") > 1, F.col("first")).alias("first_line_no"))
    found = lookup(items, item_answers(quotes, demand), {"item_key": strip(F.col("item"))}, row_id="file_id")

    def own(column: str) -> Column:
        return F.get(F.filter(column, lambda q: q["item"] == F.col("item")), F.lit(0))[column].alias(column)

    return found.select(
        "file_id",
        "item",
        "first_line_no",
        *[own(c) for c in QUOTE_ANSWERS],
        F.coalesce(F.array_contains("quoted_items", F.col("item")), F.lit(False)).alias("item_quoted"),
        "total_demand",
        "min_price",
    )


def with_item_facts(lines: DataFrame, facts: DataFrame) -> DataFrame:
    """Item facts on every line: the only shuffle of the whole lines for lookups by item.

    Joined null-safe, for a null item counts as one value. Without a first line number a line is the only one of its item.
    """
    f = facts.withColumnRenamed("file_id", "_file").withColumnRenamed("item", "_item")
    on = (lines["file_id"] == f["_file"]) & lines["item"].eqNullSafe(f["_item"])
    joined = lines.join(f, on, "left").drop("_file", "_item")
    return joined.withColumn("first_line_no", F.coalesce("first_line_no", "line_no"))


def flagged(df: DataFrame, keys: DataFrame, column: str, name: str, row_id: str | None = "item_id") -> DataFrame:
    """Membership of a column in a key set as a boolean column."""
    side = keys.select(F.col(keys.columns[0]).alias("member_key")).where(F.col("member_key").isNotNull()).distinct()
    return lookup(df, side.withColumn(name, F.lit(True)), {"member_key": F.col(column)}, row_id).withColumn(
        name, F.coalesce(name, F.lit(False))
    )


def active_cross_parts(crosses: DataFrame) -> DataFrame:
    """Part numbers and grades with an active cross, by the strict status test."""
    return crosses.where(
        (F.col("status") == rules.ACTIVE_STATUS) & F.col("house_mpn").isNotNull() & is_present(F.col("cross_ref_mpn"))
    ).select("cross_ref_mpn", "component_grade").distinct()


def pick_list(references: DataFrame) -> DataFrame:
    """Level 3 names with the base scope of their last row, sorted by name."""
    return (
        references.where(F.col("level3").isNotNull())
        .groupBy("level3")
        .agg(F.max_by("base_scope", "id").alias("base_scope"))
        .orderBy("level3")
    )
