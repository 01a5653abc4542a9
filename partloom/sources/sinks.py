"""Stored line tables and result sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.functions import rules
from partloom.functions.text import presence, stored_line_text, text_hash

# Header of the result sheet for every enriched column, in sheet order.
# Columns and headers of the result sheet.
SHEET_COLUMNS = {
    "quote_no": "SFDC QUOTE NUMBER",
    "item": "ITEM",
    "mfg_partno": "MFG_PARTNO",
    "mfg_name": "GLOBAL_MFG_NAME",
    "description": "DESCRIPTION",
    "site": "SITE",
    "std_cost": "STD_COST",
    "last_purchase_price": "LAST_PURCHASE_PRICE",
    "last_po": "LAST_PO",
    "eau": "EAU",
    "commodity": "Commodity",
    "final_scope": "Scope",
    "duplication_flag": "Part Duplication Flag",
    "cross_mpn": "Potential Cross",
    "ear": "EAR",
    "ear_status": "EAR Threshold Status",
    "previously_quoted": "Previously Quoted",
    "quote_date": "Quote Date",
    "previous_quote_number": "Previous SFDC Quote Number",
    "quoted_mpn": "Previously Quoted MPN",
    "total_demand": "Total Demand",
    "min_price": "Min Price",
}


def result_sheet(enriched: DataFrame, headers: dict[str, str] | None = None) -> DataFrame:
    """The 22 result columns under their headers, one row per line; ``headers`` replaces single headers."""
    names = {**SHEET_COLUMNS, **(headers or {})}
    return enriched.select("file_id", "line_no", *[F.col(c).alias(h) for c, h in names.items()])


def write_result_sheets(enriched: DataFrame, path: str, fmt: str = "parquet", headers: dict[str, str] | None = None) -> None:
    """Result sheets in line order, one folder per file.

    Range partitioning on (file, line) spreads a file that holds much of the data over several tasks and
    still leaves every output file sorted.
    """
    sheet = result_sheet(enriched, headers)
    ordered = sheet.repartitionByRange("file_id", "line_no").sortWithinPartitions("file_id", "line_no")
    writer = ordered.drop("line_no").write.mode("overwrite").partitionBy("file_id")
    (writer.option("header", "true") if fmt == "csv" else writer).format(fmt).save(path)


def _clustered(lines: DataFrame) -> DataFrame:
    """Lines ranged by file: a task writes few files' folders, and a large file still spreads over several tasks."""
    return lines.repartitionByRange(*[c for c in ("file_id", "line_no", "item_id") if c in lines.columns])


def append_lines(lines: DataFrame, path: str) -> None:
    _clustered(lines).write.mode("append").partitionBy("file_id").parquet(path)


def replace_files(lines: DataFrame, path: str) -> None:
    """Replace the stored lines of exactly the files in ``lines``; other files stay untouched."""
    (
        _clustered(lines).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("file_id")
        .parquet(path)
    )


def publish(lines: DataFrame, path: str) -> int:
    """Store the lines of some files as a new version and make it the current one; returns its number.

    Versions lie beside each other in ``path/lines``; a manifest names the version that counts for every file. Until the
    pointer is moved, in one atomic step and last of all, readers see the former lines, and ``lines`` may be made from
    them. A run that fails before leaves the former version in place. One writer at a time; a number is never used again by a later run,
    so what a failed run has left is not read.
    """
    spark = lines.sparkSession
    current = current_version(spark, path)
    number = max([current if current is not None else -1, *_begun(spark, path)]) + 1
    _clustered(lines).write.partitionBy("file_id").parquet(f"{path}/lines/version={number}")
    stored = spark.read.parquet(f"{path}/lines/version={number}").select(F.col("file_id").cast("bigint").alias("file_id")).distinct()
    manifest = stored.withColumn("version", F.lit(number).cast("bigint"))
    if current is not None:
        kept = spark.read.parquet(f"{path}/manifest/{current}").join(stored, "file_id", "left_anti")
        manifest = kept.unionByName(manifest)
    manifest.write.parquet(f"{path}/manifest/{number}")
    _point(spark, path, number)
    return number


def published(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the current version of every file, as they were when this was called."""
    current = current_version(spark, path)
    if current is None:
        raise ValueError(f"nothing is published in {path}")
    manifest = spark.read.parquet(f"{path}/manifest/{current}")
    named = [r["version"] for r in manifest.select("version").distinct().collect()]  # one per run that still counts
    folders = [f"{path}/lines/version={v}" for v in sorted(named)]
    lines = spark.read.option("basePath", f"{path}/lines").parquet(*folders)
    typed = lines.withColumns({c: F.col(c).cast("bigint") for c in ("file_id", "version")})
    return typed.join(manifest, ["file_id", "version"], "left_semi").drop("version")


def current_version(spark: SparkSession, path: str) -> int | None:
    fs, folder = _file_system(spark, path)
    pointer = _path(spark, f"{path}/CURRENT")
    return int(spark.read.text(f"{path}/CURRENT").first()[0]) if fs.exists(pointer) else None


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    folder = _path(spark, path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _begun(spark: SparkSession, path: str) -> list[int]:
    """Numbers of all versions that were ever begun."""
    fs, _ = _file_system(spark, path)
    lines = _path(spark, f"{path}/lines")
    names = [f.getPath().getName() for f in fs.listStatus(lines)] if fs.exists(lines) else []
    return [int(n.removeprefix("version=")) for n in names if n.startswith("version=")]


def _point(spark: SparkSession, path: str, number: int) -> None:
    """Replace the pointer by a renamed file: readers find the old or the new one, never none."""
    jvm, new, pointer = spark._jvm, _path(spark, f"{path}/NEXT-{number}"), _path(spark, f"{path}/CURRENT")
    fs, _ = _file_system(spark, path)
    out = fs.create(new, True)
    out.write(bytearray(str(number).encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    where = fs.makeQualified(pointer)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(new), where, options)


def without_files(df: DataFrame, deleted: DataFrame) -> DataFrame:
    """Rows whose file was not deleted; applied to files and lines alike."""
    return df.join(deleted.select("file_id").distinct(), "file_id", "left_anti")


def default_description(description: Column, mpn: Column) -> Column:
    return F.coalesce(presence(description), presence(mpn), F.lit(rules.NO_DESCRIPTION))


def fill_missing(df: DataFrame, column: str, value: Column) -> DataFrame:
    """Backfill: the value where the column is null."""
    return df.withColumn(column, F.coalesce(F.col(column), value))


def backfill_text_hash(lines: DataFrame) -> DataFrame:
    text = stored_line_text(F.col("item"), F.col("mfg_partno"), F.col("description"), F.col("mfg_name"))
    return fill_missing(lines, "text_hash", text_hash(text))
