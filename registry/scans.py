"""Sources, sinks and sheet mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from partloom.functions import rules
from partloom.operators import mapping
from partloom.operators.analytics import export_filter
from partloom.plans.enrich import enrich
from partloom.session import scratch_path
from partloom.sources import catalogue, sheets, side_tables, sinks
from registry import sqlx
from registry.core import num, query, sql_stamp, stamp
from registry.domain import LAYOUTS, enriched_sql

_FIELDS = ["raw_item", "raw_description", "raw_std_cost", "raw_eau"]


def written_sheets(d) -> str:
    """Sheet CSV files of all lines in a new folder: a header row and the columns of the file's layout.

    Lines are gathered by sheet first, or every task of the join would write a small CSV file for every sheet.
    """
    path = scratch_path(d.spark, "sheets")
    for number, fields in LAYOUTS.items():
        columns = [F.col(raw).alias(header.strip()) for raw, header in fields.items()]
        (
            d.raw.where(F.col("file_id") % 3 == number)
            .select("file_id", F.col("item_id").alias("ref"), *columns)
            .hint("rebalance", "file_id")
            .write.mode("append")
            .option("header", "true")
            .option("ignoreLeadingWhiteSpace", "false")
            .option("ignoreTrailingWhiteSpace", "false")
            .option("escape", '"')
            .partitionBy("file_id")
            .csv(path)
        )
    return path


def landed_sheets(d, header_only: int, other_format: int) -> str:
    """As ``written_sheets``, but one CSV file per sheet, its lines in order and without a column of ids.

    Two more uploads carry the given numbers: a header without lines and a text file.
    """
    path = scratch_path(d.spark, "landing")
    for number, fields in LAYOUTS.items():
        columns = [F.col(raw).alias(header.strip()) for raw, header in fields.items()]
        own = d.raw.where(F.col("file_id") % 3 == number).repartition("file_id").sortWithinPartitions("file_id", "line_no", "item_id")
        writer = own.select("file_id", *columns).write.mode("append").option("header", "true").option("escape", '"')
        writer.option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").partitionBy("file_id").csv(path)
    empty = d.spark.createDataFrame([("ITEM,DESCRIPTION",)], "value string").coalesce(1)
    empty.write.option("compression", "none").format("text").save(f"{path}/file_id={other_format}")
    head = d.spark.createDataFrame([], "ITEM string, DESCRIPTION string").coalesce(1)
    head.write.option("header", "true").csv(f"{path}/file_id={header_only}")
    return path


@query(
    "S1_read_sheets",
    "SELECT file_id, item_id, " + ", ".join(f"coalesce({c}, '') AS {c}" for c in _FIELDS) + " FROM raw",
    "raw",
)
def read_sheets(d):
    rows = sheets.row_maps(*sheets.read_sheets(d.spark, written_sheets(d), max_columns=16), file="file")
    names = {raw: [f[raw].strip() for f in LAYOUTS.values() if raw in f] for raw in _FIELDS}
    return rows.select(
        F.regexp_extract("file", r"file_id=(\d+)", 1).cast("bigint").alias("file_id"),
        F.element_at("cells", "ref").alias("item_id"),
        *[F.coalesce(*[F.element_at("cells", n) for n in names[raw]], F.lit("")).alias(raw) for raw in _FIELDS],
    )


@query(
    "S1_sheet_files",
    "SELECT layout, true AS readable FROM files GROUP BY layout",
    "files",
)
def sheet_files(d):
    """Listing with the format check; every written sheet is readable."""
    found = sheets.sheet_files(d.spark, written_sheets(d)).where(~F.col("file").contains("_SUCCESS"))
    file_id = F.regexp_extract("file", r"file_id=(\d+)", 1).cast("bigint")
    return found.groupBy((file_id % 3).cast("int").alias("layout")).agg(
        F.min(F.col("error_message").isNull()).alias("readable")
    )


@query(
    "S2_sample_rows",
    "SELECT file_id, item_id, sample_no FROM (SELECT file_id, item_id, row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS sample_no FROM raw) WHERE sample_no <= 5",
    "raw",
)
def sample_rows(d):
    return sheets.sample_rows(d.sheets).select("file_id", "item_id", F.col("sample_no").cast("bigint").alias("sample_no"))


_REF_COLS = ["global_code", "level1", "level2", "level3", "level3_expanded", "keyword", "mfr", "typical_mpns"]
_GENERIC = "CASE WHEN length(level3) % 5 = 0 THEN level1 WHEN length(level3) % 7 = 0 THEN 'Super Capacitor Module' ELSE level3 END"


def _some_generic(d):
    """Catalogue in which some rows must be skipped."""
    size = F.length("level3")
    level3 = F.when(size % 5 == 0, F.col("level1")).when(size % 7 == 0, "Super Capacitor Module").otherwise(F.col("level3"))
    return d.refs_plain.withColumn("level3", level3)


@query(
    "S3_load_catalogue",
    f"SELECT {', '.join(_REF_COLS)}, {sqlx.canonical('base_scope')} AS base_scope, {sqlx.canonical('auto_scope')} AS auto_scope "
    f"FROM (SELECT * REPLACE ({_GENERIC} AS level3) FROM refs_plain) WHERE level1 IS DISTINCT FROM level3 AND level3 <> 'Super Capacitor Module'",
    "refs_plain",
)
def load_catalogue(d):
    headers = {"global_code": "﻿CODE", **catalogue.CSV_HEADERS}
    source, target = scratch_path(d.spark, "catalogue-csv"), scratch_path(d.spark, "catalogue")
    (
        _some_generic(d)
        .select(*[F.col(c).alias(h) for c, h in headers.items()])
        .write.option("header", "true")
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", "false")
        .option("ignoreTrailingWhiteSpace", "false")
        .csv(source)
    )
    result = catalogue.replace_catalogue(catalogue.read_catalogue_csv(d.spark, source), target)
    assert result.success, result.error
    return d.spark.read.parquet(target)


@query(
    "S4_usable_crosses",
    "SELECT DISTINCT cross_ref_mpn, supplier_pn, house_mpn, CAST(house_cost AS DOUBLE) AS house_cost, cross_ref_mfg FROM crosses "
    "WHERE cross_ref_mpn IS NOT NULL AND component_grade = 'AUTO'",
    "crosses",
)
def usable_crosses(d):
    return side_tables.usable_crosses(d.crosses, rules.GRADE_AUTO).withColumn("house_cost", num("house_cost"))


@query(
    "S5_latest_quotes",
    f"SELECT item, {sql_stamp('log_date')} AS log_date, quote_number, quote_mpn FROM last_quotes",
    "last_quotes",
)
def latest_quotes(d):
    return side_tables.latest_quotes(d.quotes).withColumn("log_date", stamp("log_date"))


@query(
    "S6_demand_by_item",
    "SELECT item, max(total_demand) AS total_demand, CAST(min(min_price) AS DOUBLE) AS min_price FROM aml GROUP BY item",
    "aml",
)
def demand(d):
    return side_tables.demand_by_item(d.aml).withColumn("min_price", num("min_price"))


_OPPS = """
SELECT CAST(o_orderkey AS VARCHAR) AS opportunity_number, 'Opp ' || o_orderkey AS opportunity_name, c_name AS customer,
  CAST(o_orderkey % 100 AS INTEGER) AS probability, strftime(o_orderdate, '%Y-%m-%d') AS targeted_quote_deadline, c_mktsegment AS bu,
  o_orderstatus AS stage, CAST(o_totalprice AS DOUBLE) AS ear
FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'
  AND o_orderkey IN (SELECT l_orderkey FROM lineitem)
"""


@query("S7_opportunity_lookup", _OPPS)
def opportunities(d):
    """Every order number found on a line is looked up among the orders of one market segment."""
    orders = d.table("orders").join(d.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    none = F.lit(None).cast("string")
    opps = orders.select(
        F.col("o_orderkey").cast("string").alias("opportunity_number"),
        F.concat(F.lit("Opp "), "o_orderkey").alias("opportunity_name"),
        F.col("c_name").alias("customer"),
        (F.col("o_orderkey") % 100).cast("int").alias("probability"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("targeted_quote_deadline"),
        none.alias("product_application"),
        F.col("c_mktsegment").alias("bu"),
        F.col("o_orderstatus").alias("stage"),
        F.col("o_totalprice").alias("ear"),
        none.alias("site_1"),
        none.alias("bd_owner"),
        none.alias("sop_date"),
        F.col("c_mktsegment").alias("service_group"),
    )
    requests = d.table("lineitem").select(F.col("l_orderkey").cast("string").alias("opportunity_number"))
    found = side_tables.opportunity_lookup(requests, opps, "BUILDING")
    return found.drop("product_application", "site_1", "bd_owner", "sop_date")


_SHEET_SQL = ", ".join(
    f'CAST({c} AS DOUBLE) AS "{h}"'
    if c in ("std_cost", "last_purchase_price", "last_po", "ear", "min_price")
    else f'{sql_stamp(c)} AS "{h}"'
    if c == "quote_date"
    else f'{"demand" if c == "total_demand" else c} AS "{h}"'
    for c, h in sinks.SHEET_COLUMNS.items()
)


def _comparable_sheet(sheet):
    money = ["STD_COST", "LAST_PURCHASE_PRICE", "LAST_PO", "EAR", "Min Price"]
    return sheet.withColumns({**{m: num(F.col(f"`{m}`")) for m in money}, "Quote Date": stamp("`Quote Date`")})


@query("S8_result_sheet", f"SELECT file_id, {_SHEET_SQL} FROM enriched", "enriched")
def result_sheet(d):
    """The 22 columns, written per file in line order and read back."""
    path = scratch_path(d.spark, "result-sheets")
    sinks.write_result_sheets(enrich(d.lines, d.quotes, d.aml, d.crosses), path)
    back = d.spark.read.parquet(path)
    return _comparable_sheet(back.withColumn("file_id", F.col("file_id").cast("bigint")))


@query(
    "S9_export_catalogue",
    'SELECT id AS "Id", global_code AS "Global comm code desc", level1 AS "Level1 desc", level2 AS "Level2 desc", level3 AS "Level3 desc", '
    'base_scope AS "Scope status", auto_scope AS "Autograde scope", keyword AS "Keyword", mfr AS "Mfr", level3_expanded AS "Level3 desc expanded", '
    'typical_mpns AS "Typical mpn by manufacturer", \'2024-01-01\' AS "Created at", \'2024-01-02\' AS "Updated at" FROM refs_plain',
    "refs_plain",
)
def export_catalogue(d):
    path = scratch_path(d.spark, "catalogue-export")
    stamped = d.refs_plain.withColumns({"created_at": F.lit("2024-01-01"), "updated_at": F.lit("2024-01-02")})
    (
        catalogue.export_frame(stamped)
        .write.option("header", "true")
        .option("ignoreLeadingWhiteSpace", "false")
        .option("ignoreTrailingWhiteSpace", "false")
        .csv(path)
    )
    return d.spark.read.option("header", "true").csv(path).withColumn("Id", F.col("Id").cast("bigint"))


@query(
    "S10_append_lines",
    "SELECT file_id, item_id, coalesce(description, 'x') AS description FROM lines",
    "lines",
)
def append_lines(d):
    """Two appends to one table: the lines of either grade."""
    path = scratch_path(d.spark, "lines")
    for auto in (True, False):
        sinks.append_lines(d.lines.where(F.col("auto_mode") == auto).select("file_id", "item_id", "description"), path)
    return d.spark.read.parquet(path).select(F.col("file_id").cast("bigint").alias("file_id"), "item_id", "description")


_FILTERED = f"""(SELECT * FROM lines WHERE scope IS NOT NULL AND {sqlx.norm_scope('scope')} = 'In scope'
  AND (std_cost > 0 OR last_purchase_price > 0 OR last_po > 0) AND mfg_partno IS NOT NULL AND mfg_partno <> '' AND eau > 0)"""


@query(
    "S11_filtered_export",
    f"SELECT file_id, {_SHEET_SQL} FROM ({enriched_sql(_FILTERED)})",
    "lines",
    "last_quotes",
    "cross_keys",
    "aml",
)
def filtered_export(d):
    """Filters first, then the sheet: duplicate flags count inside the filtered lines."""
    kept = export_filter(d.lines, scopes=["In scope"], data=["with_prices", "with_cross_refs", "with_demand"])
    return _comparable_sheet(sinks.result_sheet(enrich(kept, d.quotes, d.aml, d.crosses)).drop("line_no"))


@query(
    "S13_replace_files",
    "SELECT file_id, item_id, CASE WHEN auto_mode THEN 'again' ELSE commodity END AS commodity FROM lines",
    "lines",
)
def replace_files(d):
    """All files are stored, then those in auto mode are replaced."""
    path = scratch_path(d.spark, "replaced")
    sinks.append_lines(d.lines.select("file_id", "item_id", "commodity"), path)
    again = d.lines.where("auto_mode").select("file_id", "item_id", F.lit("again").alias("commodity"))
    sinks.replace_files(again, path)
    return d.spark.read.parquet(path).select(F.col("file_id").cast("bigint").alias("file_id"), "item_id", "commodity")


@query(
    "S13_reprocess",
    """SELECT item_id, CASE WHEN auto_mode AND eau < 25 AND std_cost IS NOT NULL THEN 'red ' || split_part(commodity, ' ', 2) ELSE commodity END AS commodity FROM lines""",
    "lines",
)
def reprocess(d):
    """All files are published; those in auto mode are edited from their stored lines and published again in the same run."""
    path = scratch_path(d.spark, "published")
    sinks.publish(d.lines.select("file_id", "item_id", "line_no", "commodity", "auto_mode", "eau", "std_cost"), path)
    stored = sinks.published(d.spark, path)
    edited = F.when((F.col("eau") < 25) & F.col("std_cost").isNotNull(), F.concat(F.lit("red "), F.element_at(F.split("commodity", " "), 2)))
    sinks.publish(stored.where("auto_mode").withColumn("commodity", F.coalesce(edited, "commodity")), path)
    return sinks.published(d.spark, path).select("item_id", "commodity")


@query(
    "S14_delete_files",
    "SELECT item_id FROM lines WHERE file_id NOT IN (SELECT file_id FROM files WHERE status = 'failed')",
    "lines",
    "files",
)
def delete_files(d):
    return sinks.without_files(d.lines, d.files.where(F.col("status") == "failed")).select("item_id")


@query(
    "S15_backfill",
    f"SELECT item_id, CASE WHEN auto_mode THEN 'kept' ELSE sha256({sqlx.stored_text()}) END AS text_hash, coalesce(quote_no, 'Q-old') AS quote_no FROM lines",
    "lines",
)
def backfill(d):
    lines = d.lines.withColumn("text_hash", F.when(F.col("auto_mode"), "kept"))
    filled = sinks.fill_missing(sinks.backfill_text_hash(lines), "quote_no", F.lit("Q-old"))
    return filled.select("item_id", "text_hash", "quote_no")


# --- mapping ------------------------------------------------------------------------------------------


def _entries(df):
    return df.select("file_id", F.explode("mapping").alias("target", "header"))


def _expected(rows: dict[int, dict[str, str]]) -> str:
    """SQL rows (layout, target, header) spread over the files of each layout."""
    values = ", ".join(f"({n}, {sqlx.q(t)}, {sqlx.q(h)})" for n, m in rows.items() for t, h in m.items())
    return f"SELECT file_id, target, header FROM files JOIN (VALUES {values}) v(n, target, header) ON layout = n"


def _headers_sql() -> str:
    values = ", ".join(
        f"({n}, {pos}, {sqlx.q(h)})" for n, fields in LAYOUTS.items() for pos, h in enumerate(fields.values())
    )
    return f"(SELECT file_id, pos, header FROM files JOIN (VALUES {values}) v(n, pos, header) ON layout = n)"


def _leftmost(tests: dict[str, str]) -> str:
    picks = " UNION ALL ".join(
        f"SELECT file_id, {sqlx.q(t)} AS target, arg_min(header, pos) AS header FROM {_headers_sql()} WHERE {test} GROUP BY 1"
        for t, test in tests.items()
    )
    return picks


def _token_test(tokens: list[str]) -> str:
    return "(" + " OR ".join(f"contains(upper(header), {sqlx.q(t)})" for t in tokens) + ")"


_TOKEN_TESTS = {t: _token_test(rules.HEADER_TOKENS[t]) for t in rules.TARGET_COLUMNS}


@query("P1_identify_columns", _leftmost(_TOKEN_TESTS), "files")
def identify(d):
    return _entries(mapping.identify_columns(d.headers))


@query(
    "P2_mapping_from_json",
    "SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN NULL ELSE source END AS item, CASE WHEN n_chars % 3 = 0 THEN 0 WHEN n_chars % 3 = 1 THEN 2 ELSE 1 END AS targets FROM documents",
)
def from_json(d):
    """An answer per document: unreadable, with two targets, or with a null one."""
    rest = F.col("n_chars") % 3
    second = F.when(rest == 1, '"Price"').otherwise("null")
    answer = F.when(rest == 0, "no json").otherwise(
        F.concat(F.lit('{"ITEM": "'), "source", F.lit('", "STD_COST": '), second, F.lit("}"))
    )
    parsed = d.table("documents").select("doc_id", mapping.mapping_from_json(answer).alias("m"))
    return parsed.select("doc_id", F.element_at("m", "ITEM").alias("item"), F.size("m").alias("targets"))


def _samples(d):
    return sheets.sample_values(d.sheets, d.file_headers)


_SAMPLE5 = "(SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY line_no) <= 5)"


@query(
    "P3_detect_level3",
    f"""SELECT file_id, header FROM (SELECT file_id, 'LEVEL3_DESC' AS header, avg(CASE WHEN {sqlx.squeeze('v')} IN
    (SELECT {sqlx.squeeze('level3')} FROM refs_plain) THEN 1.0 ELSE 0.0 END) AS score
    FROM (SELECT DISTINCT file_id, {sqlx.strip('raw_level3')} AS v FROM {_SAMPLE5} WHERE raw_level3 IS NOT NULL) WHERE v <> '' GROUP BY 1) WHERE score > 0.5""",
    "raw",
    "refs_plain",
)
def detect_level3(d):
    return mapping.detect_hierarchy_column(d.headers, _samples(d), d.refs_plain, "LEVEL3_DESC")


@query(
    "P3_score_level1",
    f"""SELECT file_id, header, coalesce(avg(CASE WHEN {sqlx.squeeze('v')} IN (SELECT {sqlx.squeeze('level1')} FROM refs_plain)
    THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 0.0) AS score FROM (SELECT DISTINCT file_id, 'Level 1' AS header, {sqlx.strip('raw_level1')} AS v
    FROM {_SAMPLE5} WHERE raw_level1 IS NOT NULL) GROUP BY 1, 2""",
    "raw",
    "refs_plain",
)
def score_level1(d):
    scored = mapping.score_hierarchy_columns(d.headers, _samples(d), d.refs_plain, "LEVEL1_DESC")
    return scored.select("file_id", "header", "score")


# Rival columns of one target: texts of a column by header, the raw field they hold and the lines in which they hold it.
_RIVALS = {
    "Level2 old": ("raw_global_code", "line_no % 3 = 0", "item_id"),
    "My Level 2": ("raw_global_code", "file_id % 4 <> 0", "file_id"),
    "LEVEL_2": ("raw_global_code", "line_no % 2 = 0 OR file_id % 4 = 1", "line_no"),
    "global_comm_code (own)": ("raw_item", "file_id % 2 = 0", "file_id"),
    "Global_Commodity_Code": ("raw_global_code", "file_id % 5 <> 0", "item_id"),
    "GLOBAL COMM CODE": ("raw_global_code", "line_no % 3 <> 1", "item_id"),
    "Level1": ("raw_level1", "line_no % 4 <> 2", "item_id"),
    "ITEM": ("raw_item", "true", "item_id"),
    "LEVEL3_DESC": ("raw_level3", "file_id % 3 <> 1", "item_id"),
}


def _rival_sheets(d):
    """Headers by position and sheet rows of files in which several columns claim to be the same target."""
    cells = [F.expr(f"CASE WHEN {when} THEN {raw} ELSE CAST({other} AS STRING) END") for raw, when, other in _RIVALS.values()]
    headers = d.files.select("file_id", F.array(*[F.lit(h) for h in _RIVALS]).alias("headers"))
    return headers, d.raw.select("file_id", "item_id", "line_no", F.array(*cells).alias("values"))


_RIVAL_SAMPLE = "(SELECT * FROM raw_all QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY line_no) <= 5)"
_RIVAL_CELLS = " UNION ALL ".join(
    f"SELECT file_id, {pos} AS pos, {sqlx.q(h)} AS header, CASE WHEN {when} THEN {raw} ELSE CAST({other} AS VARCHAR) END AS cell FROM {_RIVAL_SAMPLE}"
    for pos, (h, (raw, when, other)) in enumerate(_RIVALS.items())
)


def _found_by_content(target: str, column: str) -> str:
    """Best rival of a target: share of distinct cells that the catalogue knows, ties to the left, above the threshold."""
    named = " OR ".join(f"contains(lower(header), {sqlx.q(h)})" for h in rules.HIERARCHY_HEADERS[target])
    return f"""SELECT file_id, arg_max(header, score * 1000 - pos) AS header FROM (
    SELECT file_id, pos, header, avg(CASE WHEN {sqlx.squeeze('v')} IN (SELECT {sqlx.squeeze(column)} FROM refs_plain) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS score
    FROM (SELECT DISTINCT file_id, pos, header, {sqlx.strip('cell')} AS v FROM ({_RIVAL_CELLS}) WHERE ({named}) AND cell IS NOT NULL)
    WHERE v <> '' GROUP BY 1, 2, 3) GROUP BY 1 HAVING max(score) > {rules.HIERARCHY_THRESHOLDS[target]}"""


def _by_content(d, target: str):
    headers, rows = _rival_sheets(d)
    return mapping.detect_hierarchy_column(sheets.header_table(headers), sheets.sample_values(rows, headers), d.refs_plain, target)


@query("P3_detect_level2", _found_by_content("LEVEL2_DESC", "level2"), "raw_all", "refs_plain")
def detect_level2(d):
    return _by_content(d, "LEVEL2_DESC")


@query("P3_detect_global_code", _found_by_content("GLOBAL_COMM_CODE_DESC", "global_code"), "raw_all", "refs_plain")
def detect_global_code(d):
    return _by_content(d, "GLOBAL_COMM_CODE_DESC")


def _merged_sql() -> str:
    """Header rules for every target; the level columns found by content take their targets over."""
    rival_headers = ", ".join(f"({pos}, {sqlx.q(h)})" for pos, h in enumerate(_RIVALS))
    ruled = " UNION ALL ".join(
        f"SELECT {sqlx.q(t)} AS target, arg_min(header, pos) AS header FROM (VALUES {rival_headers}) v(pos, header) WHERE {test}"
        for t, test in _TOKEN_TESTS.items()
    )
    found = " UNION ALL ".join(
        f"SELECT file_id, {sqlx.q(t)} AS target, header FROM ({_found_by_content(t, c)})"
        for t, c in (("LEVEL1_DESC", "level1"), ("LEVEL2_DESC", "level2"), ("LEVEL3_DESC", "level3"))
    )
    return f"""SELECT file_id, target, header FROM ({found})
  UNION ALL SELECT file_id, target, header FROM files CROSS JOIN ({ruled}) WHERE header IS NOT NULL AND (file_id, target) NOT IN (SELECT (file_id, target) FROM ({found}))"""


@query("P3_merged_mapping", _merged_sql(), "files", "raw_all", "refs_plain")
def merged_mapping(d):
    headers, rows = _rival_sheets(d)
    return _entries(mapping.detect_mapping(sheets.header_table(headers), sheets.sample_values(rows, headers), d.refs_plain))


@query("P4_exact_global_code", _expected({1: {"GLOBAL_COMM_CODE_DESC": " GLOBAL COMM CODE DESC "}}), "files")
def exact_global(d):
    return _entries(mapping.exact_global_code_column(d.headers))


_PREVIEW_TESTS = {t: _token_test([k]) for t, k in rules.PREVIEW_TOKENS.items()}


@query("P5_preview_columns", _leftmost(_PREVIEW_TESTS), "files")
def preview(d):
    return _entries(mapping.preview_hierarchy_columns(d.headers))


@query(
    "P6_manual_mapping",
    f"SELECT file_id, target, CASE WHEN file_id % 2 = 0 THEN header ELSE 'by hand' END AS header FROM ({_leftmost({t: _TOKEN_TESTS[t] for t in ('ITEM', 'EAU')})})"
    " WHERE file_id % 2 = 0 OR target = 'ITEM'",
    "files",
)
def manual(d):
    """Every other file has a mapping by hand with a single target, which replaces detection as a whole."""
    detected = mapping.identify_columns(d.headers, ["ITEM", "EAU"])
    by_hand = F.when(F.col("file_id") % 2 == 1, F.create_map(F.lit("ITEM"), F.lit("by hand")))
    return _entries(detected.withColumn("mapping", mapping.override_mapping(F.col("mapping"), by_hand)))


@query(
    "P7_apply_mapping",
    "SELECT item_id, raw_item, raw_mpn, raw_mfg, raw_description, raw_site, raw_std_cost, raw_eau, raw_level3, raw_global_code FROM raw",
    "raw",
)
def apply(d):
    return mapping.apply_mapping(d.sheets, d.mapped_files).select(
        "item_id", "raw_item", "raw_mpn", "raw_mfg", "raw_description", "raw_site", "raw_std_cost", "raw_eau", "raw_level3", "raw_global_code"
    )


@query(
    "P8_commodity_path",
    "SELECT file_id, CASE layout WHEN 0 THEN 'level3' WHEN 1 THEN 'global_code' ELSE 'similarity' END AS path FROM files",
    "files",
)
def path(d):
    return d.mapped_files.select("file_id", mapping.commodity_path(F.col("mapping")).alias("path"))


@query(
    "P9_file_options",
    "SELECT item_id, f.auto_mode, f.demand_lookup, f.volume_multiplier FROM raw_all JOIN files f USING (file_id)",
    "raw_all",
    "files",
)
def options(d):
    rows = d.raw.select("file_id", "item_id")
    return rows.join(mapping.file_options(d.mapped_files), "file_id").select("item_id", "auto_mode", "demand_lookup", "volume_multiplier")


@query(
    "P10_review_records",
    f"""SELECT vec_id AS item_id, string_agg(rank || '|' || ref_id || '|' || pct, ';' ORDER BY rank) AS similar
    FROM (SELECT key AS vec_id, ref_id, rank, CAST(CAST(round(sim * 100, 2) AS DECIMAL(10,2)) AS VARCHAR) AS pct FROM ranked) GROUP BY 1""",
    "ranked",
)
def review_records(d):
    """Ranked references of every vector as one list of records."""
    from partloom.operators.corrections import candidate_lists
    from partloom.operators.nearest import similar_references

    names = d.centroids.select(
        F.col("ref_id").alias("id"),
        F.col("ref_id").cast("string").alias("level3"),
        *[F.lit(None).cast("string").alias(c) for c in ("global_code", "level1", "level2", "level3_expanded", "base_scope", "keyword", "mfr", "typical_mpns")],
    )
    lists = candidate_lists(similar_references(d.vectors, d.centroids), names)
    shown = F.transform(
        "similar", lambda r: F.concat_ws("|", r["rank"], r["name"], r["percent"].cast("decimal(10,2)"))
    )
    return lists.select(F.col("key").alias("item_id"), F.array_join(shown, ";").alias("similar"))
