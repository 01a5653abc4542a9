"""Reference catalogue: load, validate, export."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.functions import rules
from partloom.functions.scope import canonical_scope
from partloom.functions.text import is_blank, is_present
from partloom.session import written

REFERENCE_COLUMNS = [
    "global_code",
    "level1",
    "level2",
    "level3",
    "level3_expanded",
    "base_scope",
    "auto_scope",
    "keyword",
    "mfr",
    "typical_mpns",
]

# CSV header of every catalogue column but the first, which is read by position.
# Headers of the catalogue sheet.
CSV_HEADERS = {
    "level1": "LEVEL1_DESC",
    "level2": "LEVEL2_DESC",
    "level3": "LEVEL3_DESC",
    "level3_expanded": "LEVEL3_DESC_EXPANDED",
    "base_scope": "SCOPE STATUS",
    "auto_scope": "autograde_scope",
    "keyword": "KEYWORDS",
    "mfr": "MFR",
    "typical_mpns": "TYPICAL_MPN_BY_MANUFACTURER",
}

# Headers of the catalogue export.
EXPORT_HEADERS = {
    "id": "Id",
    "global_code": "Global comm code desc",
    "level1": "Level1 desc",
    "level2": "Level2 desc",
    "level3": "Level3 desc",
    "base_scope": "Scope status",
    "auto_scope": "Autograde scope",
    "keyword": "Keyword",
    "mfr": "Mfr",
    "level3_expanded": "Level3 desc expanded",
    "typical_mpns": "Typical mpn by manufacturer",
    "created_at": "Created at",
    "updated_at": "Updated at",
}


def is_skipped(level1: Column, level3: Column) -> Column:
    """Generic rows (both levels equal, two nulls included) and rows on the exclusion list."""
    return level1.eqNullSafe(level3) | F.coalesce(level3.isin(rules.EXCLUDED_LEVEL3), F.lit(False))


def reference_problems() -> Column:
    """Reasons a catalogue row is invalid; empty when it is fine."""
    known = [rules.STORED_IN_SCOPE, rules.STORED_OUT_OF_SCOPE]
    auto = F.col("auto_scope")
    return F.array_compact(
        F.array(
            F.when(is_blank(F.col("level3")), F.lit("level3 missing")),
            F.when(is_present(auto) & ~canonical_scope(auto).isin(known), F.lit("autograde scope unknown")),
        )
    )


def read_catalogue_csv(spark: SparkSession, path: str, headers: dict[str, str] | None = None) -> DataFrame:
    """Catalogue rows of a CSV file; a byte order mark before the first header is ignored."""
    names = {**CSV_HEADERS, **(headers or {})}
    raw = spark.read.option("header", "true").option("escape", '"').option("multiLine", "true").csv(path)
    clean = [c.lstrip("﻿").strip() for c in raw.columns]
    raw = raw.toDF(*clean)
    columns = [F.col(f"`{clean[0]}`").alias("global_code")]
    for column, header in names.items():
        present = header in clean
        columns.append((F.col(f"`{header}`") if present else F.lit(None).cast("string")).alias(column))
    return raw.select(*columns)


@dataclass
class LoadResult:
    success: bool
    count: int = 0
    error: str | None = None


def prepare_references(raw: DataFrame) -> DataFrame:
    """Skip rule, validation column and stored scope spellings."""
    return (
        raw.where(~is_skipped(F.col("level1"), F.col("level3")))
        .withColumn("problems", reference_problems())
        .withColumn("base_scope", canonical_scope(F.col("base_scope")))
        .withColumn("auto_scope", canonical_scope(F.col("auto_scope")))
    )


def replace_catalogue(raw: DataFrame, target: str) -> LoadResult:
    """Replace the stored catalogue by ``raw``, all rows or none."""
    staged = written(prepare_references(raw), "catalogue")
    totals = staged.agg(
        F.count("*").alias("n"), F.count(F.when(F.size("problems") > 0, 1)).alias("bad"), F.max("problems").alias("why")
    ).first()
    if totals["bad"]:
        return LoadResult(False, error=f"{totals['bad']} invalid rows: {', '.join(totals['why'])}")
    staged.drop("problems").write.mode("overwrite").parquet(target)
    return LoadResult(True, count=totals["n"])


def export_frame(references: DataFrame) -> DataFrame:
    """The 13 exported attributes under their headers, in id order."""
    return references.orderBy("id").select(*[F.col(c).alias(h) for c, h in EXPORT_HEADERS.items()])


def without_embedding(references: DataFrame) -> DataFrame:
    return references.where(F.col("embedding").isNull() | (F.size("embedding") == 0))
