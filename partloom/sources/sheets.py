"""Item sheets with arbitrary headers: many CSV files read as one frame of cell arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partloom.functions import rules
from partloom.session import written

MAX_COLUMNS = 256
_SHEET_EXTENSIONS = ["csv"]
_RECORD = "_record"


def sheet_schema(max_columns: int = MAX_COLUMNS) -> T.StructType:
    return T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(max_columns)])


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def sheet_files(spark: SparkSession, path: str) -> DataFrame:
    """Files below a path with an error text for formats that cannot be read.

    Only names and sizes are read; the content column is pruned.
    """
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select(
            F.col("path").alias("file"),
            F.col("length").alias("bytes"),
            F.when(
                ~extension(F.col("path")).isin(_SHEET_EXTENSIONS),
                F.concat(F.lit("Unsupported file format: "), name),
            ).alias("error_message"),
        )
    )


def _positioned(raw: DataFrame, max_columns: int) -> DataFrame:
    """Cells of every record with its place in the file.

    Splits of one file are ordered by their byte offset and records of one split by the running id, so the
    pair orders the whole file without a sort.
    """
    values = F.array(*[F.col(f"c{i}") for i in range(max_columns)])
    too_wide = F.col("too_wide") if "too_wide" in raw.columns else F.lit(False)
    return raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(
            F.col("_metadata.file_block_start").alias("offset"),
            F.monotonically_increasing_id().alias("record"),
        ).alias("position"),
        values.alias("values"),
        too_wide.alias("too_wide"),
    )


def split_headers(raw: DataFrame, max_columns: int = MAX_COLUMNS) -> tuple[DataFrame, DataFrame]:
    """Data rows and headers of the records of many files.

    Rows are ``file, position, values``; headers ``file, headers``, one row per file, where ``values`` and
    ``headers`` run in step. Header texts are not repeated on the rows. The headers are written: their size is then known
    to Spark's own check, which need not shuffle all rows to find the headers of a moderate number of files.
    """
    records = _positioned(raw, max_columns)
    first = (
        records.where(F.col("position.offset") == 0)
        .groupBy("file")
        .agg(F.min_by("values", "position").alias("headers"), F.min("position").alias("header_position"))
    )
    headers = written(first, "headers")
    rows = records.join(headers.select("file", "header_position"), "file").where(
        F.col("position") > F.col("header_position")
    )
    return rows.select("file", "position", "values", "too_wide"), headers.select("file", "headers")


def read_sheets(
    spark: SparkSession, path: str | list[str], max_columns: int = MAX_COLUMNS, splittable: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Rows and headers of all CSV sheets below a path; every cell stays text.

    Quoted cells may hold line breaks, so a sheet is read by one task; ``splittable`` reads a huge sheet without such
    cells by many. A record of more than ``max_columns`` cells is kept as far as they go and flagged ``too_wide``, which
    fails its file.
    """
    raw = (
        spark.read.schema(sheet_schema(max_columns).add(_RECORD, "string"))
        .option("header", "false")
        .option("escape", '"')
        .option("multiLine", str(not splittable).lower())
        .option("columnNameOfCorruptRecord", _RECORD)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.[cC][sS][vV]")
        .csv(path)
    )
    return split_headers(raw.withColumn("too_wide", is_wide(F.col(_RECORD), max_columns)), max_columns)


def is_wide(record: Column, max_columns: int) -> Column:
    """Whether a record has more cells than allowed. The reader hands over the text of records that do not fit its
    columns; separators outside quotes are counted."""
    bare = F.regexp_replace(record, r'"(?:[^"]|"")*"', "")
    return F.coalesce(F.length(bare) - F.length(F.translate(bare, ",", "")) >= max_columns, F.lit(False))


def row_maps(rows: DataFrame, headers: DataFrame, file: str = "file_id") -> DataFrame:
    """Rows as header -> cell maps; the last column of a repeated header counts, unnamed columns do not.

    Which columns count is found once per file, so a row only picks array elements.
    """
    kept = F.filter(
        F.sequence(F.lit(0), F.size("headers") - 1),
        lambda i: F.get("headers", i).isNotNull() & (last_position(F.col("headers"), F.get("headers", i)) == i),
    )
    placed = headers.withColumn("_kept", kept).withColumn("_names", F.transform("_kept", lambda i: F.get("headers", i)))
    cells = F.map_from_arrays("_names", F.transform("_kept", lambda i: F.get("values", i)))
    return rows.join(placed, file).withColumn("cells", cells).drop("_kept", "_names")


def last_position(headers: Column, header: Column) -> Column:
    """Index from 0 of the last column with a header; null when there is none."""
    from_end = F.array_position(F.reverse(headers), header)
    return F.when(from_end > 0, (F.size(headers) - from_end).cast("int"))


def sample_rows(rows: DataFrame, file: str = "file_id", order: str = "line_no", n: int = rules.SAMPLE_ROWS) -> DataFrame:
    """First ``n`` data rows of every file; the limit per group is applied before the shuffle as well."""
    w = Window.partitionBy(file).orderBy(order)
    return rows.withColumn("sample_no", F.row_number().over(w)).where(F.col("sample_no") <= n)


def header_table(headers: DataFrame, file: str = "file_id") -> DataFrame:
    """``file, pos, header``: one row per named column of a file."""
    return headers.select(file, F.posexplode("headers").alias("pos", "header")).where(F.col("header").isNotNull())


def sample_values(rows: DataFrame, headers: DataFrame, file: str = "file_id", order: str = "line_no") -> DataFrame:
    """``file, header, value`` of the sample rows."""
    sample = sample_rows(rows.select(file, order, "values"), file, order).join(headers, file)
    return sample.select(file, F.explode(F.arrays_zip("headers", "values")).alias("cell")).select(
        file, F.col("cell.headers").alias("header"), F.col("cell.values").alias("value")
    )
