"""From arbitrary headers to the fixed target columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.functions import rules
from partloom.functions.money import apply_multiplier, clean_money, clean_quantity
from partloom.functions.scope import grade_of
from partloom.functions.text import is_blank, is_present, presence, squeeze_key, strip
from partloom.operators.lookup import lookup
from partloom.sources.sheets import last_position
from partloom.sources.side_tables import catalogue_values
from partloom.sources.sinks import default_description

MAP_TYPE = "map<string,string>"


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _mapping_per_file(headers: DataFrame, tests: dict[str, Column], file: str) -> DataFrame:
    """One pass: for every target the leftmost header that satisfies its test, as a target -> header map.

    Each target is one ``min_by`` of the same aggregate, so the headers are neither crossed with the rules
    nor shuffled more than once.
    """
    picks = [
        F.min_by("header", F.when(test, F.col("pos"))).alias(f"t{i}") for i, test in enumerate(tests.values())
    ]
    entries = F.array(*[F.struct(F.lit(t).alias("k"), F.col(f"t{i}").alias("v")) for i, t in enumerate(tests)])
    matched = F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))
    return headers.groupBy(file).agg(*picks).select(file, matched.alias("mapping"))


def identify_columns(headers: DataFrame, targets: list[str] | None = None, file: str = "file_id") -> DataFrame:
    """Rule-based mapping by header tokens; one header may serve several targets."""
    upper = F.upper("header")
    wanted = targets or rules.TARGET_COLUMNS
    tests = {t: _any([upper.contains(token) for token in rules.HEADER_TOKENS[t]]) for t in wanted}
    return _mapping_per_file(headers, tests, file)


def preview_hierarchy_columns(headers: DataFrame, file: str = "file_id") -> DataFrame:
    """Commodity columns by header alone, as shown before a run."""
    upper = F.upper("header")
    return _mapping_per_file(headers, {t: upper.contains(k) for t, k in rules.PREVIEW_TOKENS.items()}, file)


def exact_global_code_column(headers: DataFrame, file: str = "file_id") -> DataFrame:
    test = strip(F.col("header")).isin(rules.EXACT_GLOBAL_CODE_HEADERS)
    return _mapping_per_file(headers, {"GLOBAL_COMM_CODE_DESC": test}, file)


def hierarchy_candidates(headers: DataFrame, target: str) -> DataFrame:
    lower = F.lower("header")
    return headers.where(_any([lower.contains(s) for s in rules.HIERARCHY_HEADERS[target]]))


_CATALOGUE_COLUMN = {
    "LEVEL1_DESC": "level1",
    "LEVEL2_DESC": "level2",
    "LEVEL3_DESC": "level3",
    "GLOBAL_COMM_CODE_DESC": "global_code",
}


def score_hierarchy_columns(
    headers: DataFrame, samples: DataFrame, references: DataFrame, target: str, file: str = "file_id"
) -> DataFrame:
    """Share of distinct sample values of each candidate column that the catalogue knows.

    ``samples`` holds ``file, header, value`` of the sample rows. Returns ``file, pos, header, score``; a
    candidate without values scores 0.
    """
    candidates = hierarchy_candidates(headers, target)
    values = (
        samples.select(file, "header", strip(F.col("value")).alias("value"))
        .where(F.col("value") != "")
        .distinct()
        .withColumn("value_key", squeeze_key(F.col("value")))
    )
    known = catalogue_values(references, _CATALOGUE_COLUMN[target]).withColumn("known", F.lit(1.0))
    return (
        candidates.join(values, [file, "header"], "left")
        .join(known, "value_key", "left")
        .groupBy(file, "pos", "header")
        .agg(
            (
                F.coalesce(F.sum("known"), F.lit(0.0)) / F.greatest(F.count("value_key"), F.lit(1))
            ).alias("score")
        )
    )


def detect_hierarchy_column(
    headers: DataFrame, samples: DataFrame, references: DataFrame, target: str, file: str = "file_id"
) -> DataFrame:
    """``file, header`` of the best candidate above the threshold; ties go to the leftmost.

    With no catalogue value to compare with, the first candidate is taken.
    """
    scored = score_hierarchy_columns(headers, samples, references, target, file)
    best = scored.groupBy(file).agg(
        F.max_by("header", F.struct("score", (-F.col("pos")).alias("left"))).alias("best"),
        F.max("score").alias("best_score"),
        F.min_by("header", "pos").alias("first_candidate"),
    )
    values = references.agg(F.count(_CATALOGUE_COLUMN[target])).scalar()
    chosen = F.when(values == 0, F.col("first_candidate")).when(
        F.col("best_score") > rules.HIERARCHY_THRESHOLDS[target], F.col("best")
    )
    return best.select(file, chosen.alias("header")).where(F.col("header").isNotNull())


def detect_mapping(
    headers: DataFrame, samples: DataFrame, references: DataFrame, file: str = "file_id"
) -> DataFrame:
    """Mapping of a run: header rules, content-checked hierarchy columns, exact global code column."""
    mapping = identify_columns(headers, file=file)
    for target in ["LEVEL1_DESC", "LEVEL2_DESC", "LEVEL3_DESC"]:
        found = detect_hierarchy_column(headers, samples, references, target, file).select(
            file, F.create_map(F.lit(target), F.col("header")).alias("extra")
        )
        mapping = _merge(mapping, found, file)
    return _merge(mapping, exact_global_code_column(headers, file).withColumnRenamed("mapping", "extra"), file)


def _merge(mapping: DataFrame, extra: DataFrame, file: str) -> DataFrame:
    merged = F.when(F.col("extra").isNull(), F.col("mapping")).otherwise(
        F.map_concat(
            F.map_filter("mapping", lambda k, _: ~F.array_contains(F.map_keys("extra"), k)), F.col("extra")
        )
    )
    return mapping.join(extra, file, "left").select(file, merged.alias("mapping"))


def mapping_from_json(c: Column) -> Column:
    """Mapping given as a JSON object target -> header; unreadable text gives an empty mapping."""
    parsed = F.from_json(c, MAP_TYPE)
    return F.map_filter(F.coalesce(parsed, F.from_json(F.lit("{}"), MAP_TYPE)), lambda _, v: v.isNotNull())


def override_mapping(detected: Column, manual: Column) -> Column:
    """A non-empty manual mapping replaces detection as a whole."""
    return F.when(F.coalesce(F.size(manual), F.lit(0)) > 0, manual).otherwise(detected)


def commodity_path(mapping: Column) -> Column:
    """Which column classifies a file: level 3, else the global code, else similarity."""
    return (
        F.when(is_present(F.element_at(mapping, "LEVEL3_DESC")), "level3")
        .when(is_present(F.element_at(mapping, "GLOBAL_COMM_CODE_DESC")), "global_code")
        .otherwise("similarity")
    )


# Raw line column of every target.
RAW_COLUMNS = {
    "raw_quote_no": "SFDC QUOTE NUMBER",
    "raw_item": "ITEM",
    "raw_mpn": "MFG_PARTNO",
    "raw_mfg": "GLOBAL_MFG_NAME",
    "raw_description": "DESCRIPTION",
    "raw_site": "SITE",
    "raw_std_cost": "STD_COST",
    "raw_last_purchase_price": "LAST_PURCHASE_PRICE",
    "raw_last_po": "LAST_PO",
    "raw_eau": "EAU",
    "raw_level1": "LEVEL1_DESC",
    "raw_level2": "LEVEL2_DESC",
    "raw_level3": "LEVEL3_DESC",
    "raw_global_code": "GLOBAL_COMM_CODE_DESC",
}


def file_options(files: DataFrame) -> DataFrame:
    """One row per file: its options, and for every target the position of the mapped column.

    Headers are resolved here, once per file, so a row only picks array elements.
    """
    slots = [
        last_position(F.col("headers"), F.element_at("mapping", target)).alias(column)
        for column, target in RAW_COLUMNS.items()
    ]
    return files.select(
        "file_id",
        F.struct(*slots).alias("slots"),
        commodity_path(F.col("mapping")).alias("path"),
        F.coalesce("auto_mode", F.lit(False)).alias("auto_mode"),
        F.coalesce("demand_lookup", F.lit(False)).alias("demand_lookup"),
        "volume_multiplier",
    )


def apply_mapping(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Raw target cells and file options on every row; an unmapped target is null.

    ``rows`` holds ``file_id, values``; ``files`` holds ``headers``, ``mapping`` and the options.
    """
    joined = rows.join(file_options(files), "file_id")
    return joined.withColumns({c: F.get("values", F.col(f"slots.{c}")) for c in RAW_COLUMNS}).drop("values", "slots")


def item_or_mpn(item: Column, mpn: Column) -> Column:
    return F.when(is_blank(item) & is_present(mpn), mpn).otherwise(item)


def standardize_names(lines: DataFrame, names: DataFrame, column: str = "mfg_name", trimmed: bool = False) -> DataFrame:
    """Standard manufacturer name by exact key; an unknown name stays as it is."""
    key = strip(F.col(column)) if trimmed else F.col(column)
    hit = names.select(F.col("original_name").alias("alias_key"), "standardized_name")
    return lookup(lines, hit, {"alias_key": key}).withColumn(column, F.coalesce("standardized_name", column)).drop("standardized_name")


def standard_columns(mapped: DataFrame) -> DataFrame:
    """Typed line columns from the raw target cells (manufacturer still as written)."""
    description = F.col("raw_description")
    return mapped.withColumns(
        {
            "quote_no": F.col("raw_quote_no"),
            "item": item_or_mpn(F.col("raw_item"), F.col("raw_mpn")),
            "mfg_partno": F.col("raw_mpn"),
            "mfg_name": F.col("raw_mfg"),
            "description": default_description(description, F.col("raw_mpn")),
            "site": F.col("raw_site"),
            "std_cost": clean_money(F.col("raw_std_cost")),
            "last_purchase_price": clean_money(F.col("raw_last_purchase_price")),
            "last_po": clean_money(F.col("raw_last_po")),
            "eau": apply_multiplier(clean_quantity(F.col("raw_eau")), F.col("volume_multiplier")),
            "grade": grade_of(F.col("auto_mode")),
        }
    )


def line_problems(too_wide: Column | None = None) -> Column:
    """Reasons a line is invalid; empty when it is fine.

    Cleaned numbers are null only for an empty cell or a number beyond the column type. ``too_wide`` marks a record
    with more cells than a sheet may have.
    """
    overflow = [
        F.when(F.col(f"raw_{c}").isNotNull() & F.col(c).isNull(), F.lit(f"{c} not a number"))
        for c in ("std_cost", "last_purchase_price", "last_po")
    ]
    return F.array_compact(
        F.array(
            F.when(too_wide, F.lit("record too wide")) if too_wide is not None else F.lit(None).cast("string"),
            F.when(is_blank(F.col("item")), F.lit("item missing")),
            F.when(is_blank(F.col("description")), F.lit("description missing")),
            *overflow,
            F.when(presence(F.col("raw_eau")).isNotNull() & F.col("eau").isNull(), F.lit("eau not a number")),
        )
    )


def file_verdicts(lines: DataFrame) -> DataFrame:
    """``file_id, valid, error_message``: one invalid line fails its file."""
    return lines.groupBy("file_id").agg(
        F.min(F.size("problems") == 0).alias("valid"), F.min(F.get("problems", F.lit(0))).alias("error_message")
    )
