"""The whole run over many files: standardise, classify, enrich, report file status."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.operators.classify import Embedder, classify_by_similarity, classify_existing
from partloom.operators.mapping import file_verdicts
from partloom.plans.enrich import enrich
from partloom.plans.standardize import standardize
from partloom.session import written
from partloom.sources.side_tables import crosses_by_mpn, crosses_by_status, demand_by_item, latest_quotes, manufacturer_names

LINE_COLUMNS = [
    "file_id",
    "item_id",
    "line_no",
    "quote_no",
    "item",
    "mfg_partno",
    "mfg_name",
    "description",
    "site",
    "std_cost",
    "last_purchase_price",
    "last_po",
    "eau",
    "commodity",
    "scope",
    "embedding",
    "text_hash",
]
OPTION_COLUMNS = ["auto_mode", "demand_lookup", "grade", "has_cross", "active_cross", "cross_mpn"]


@dataclass
class SideTables:
    """Everything a run looks up. A missing table must be given as an empty frame, never silently left out."""

    references: DataFrame
    manufacturers: DataFrame
    crosses: DataFrame
    quotes: DataFrame
    aml: DataFrame


def written_sides(sides: SideTables) -> SideTables:
    """The same side tables for many runs: reduced to what a run looks up and written once.

    Every reduction leaves the answers of a run as they are, so that a run over few files does not read and shuffle the
    whole side tables anew.
    """
    return SideTables(
        written(sides.references, "side-references"),
        written(manufacturer_names(sides.manufacturers), "side-manufacturers"),
        written(crosses_by_status(sides.crosses), "side-crosses"),
        written(latest_quotes(sides.quotes), "side-quotes"),
        written(demand_by_item(sides.aml), "side-aml"),
    )


@dataclass
class RunResult:
    lines: DataFrame
    enriched: DataFrame
    status: DataFrame


def classify(
    lines: DataFrame,
    sides: SideTables,
    embedder: Embedder,
    stored: DataFrame | None = None,
    previous: DataFrame | None = None,
    line_edits: DataFrame | None = None,
    changes: DataFrame | None = None,
) -> DataFrame:
    """Classified lines of both kinds of file."""
    crosses = crosses_by_mpn(sides.crosses)
    edits = (previous, line_edits, changes)
    existing = classify_existing(lines.where(F.col("path") != "similarity"), sides.references, crosses, *edits)
    searched = classify_by_similarity(
        lines.where(F.col("path") == "similarity"), sides.references, crosses, embedder, stored, *edits
    )
    keep = LINE_COLUMNS + OPTION_COLUMNS
    return existing.select(*keep).unionByName(searched.select(*keep))


def file_status(verdicts: DataFrame) -> DataFrame:
    """Final status of every file, with the reason of a failure."""
    return verdicts.select(
        "file_id",
        F.when(F.col("valid"), "completed").otherwise("failed").alias("status"),
        F.when(~F.col("valid"), F.col("error_message")).alias("error_message"),
    )


def process_files(
    rows: DataFrame,
    files: DataFrame,
    sides: SideTables,
    embedder: Embedder,
    stored: DataFrame | None = None,
    previous: DataFrame | None = None,
    line_edits: DataFrame | None = None,
    changes: DataFrame | None = None,
    cut: bool = True,
) -> RunResult:
    """Run all files at once. A file with an invalid line fails as a unit and yields no lines.

    With ``cut`` the standardised and the classified lines are written to the shared folder once each: the
    first feed the verdicts and both kinds of classification, the second the stored table, the result sheet
    and the figures. Readers of the written tables load only the columns they need.
    """
    standard = standardize(rows, files, sides.manufacturers)
    if cut:
        standard = written(standard, "standard")
    verdicts = file_verdicts(standard)
    passed = verdicts.where(F.col("valid")).select("file_id")
    good = standard.join(passed, "file_id", "left_semi")
    classified = classify(good, sides, embedder, stored, previous, line_edits, changes)
    if cut:
        classified = written(classified, "classified")
    return RunResult(classified, enrich(classified, sides.quotes, sides.aml), file_status(verdicts))
