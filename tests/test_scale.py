"""Work that must grow with the rows, not with the product of tasks, files or batches."""

import glob
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from partloom.functions.text import text_hash
from partloom.functions.vectors import stand_in_embedding
from partloom.operators import reuse
from partloom.operators.corrections import review_outcomes
from partloom.operators.remap import line_edits_for, matched_previous
from partloom.plans.enrich import enrich
from partloom.plans.process import SideTables, process_files, written_sides
from partloom.sources import sheets
from partloom.sources.side_tables import crosses_by_mpn, crosses_by_status
from registry.scans import written_sheets
from tests.test_operators import references


class Lines:
    """Raw lines of six sheets, dealt over many tasks."""

    def __init__(self, spark):
        self.spark = spark
        names = ["raw_quote_no", "raw_item", "raw_description", "raw_mpn", "raw_mfg", "raw_std_cost", "raw_last_purchase_price"]
        names += ["raw_last_po", "raw_eau", "raw_site", "raw_level1", "raw_level3", "raw_global_code"]
        rows = spark.range(600).select((F.col("id") % 6).alias("file_id"), F.col("id").cast("string").alias("item_id"), *[F.lit("x").alias(n) for n in names])
        self.raw = rows.repartition(16, "item_id")


def test_a_sheet_is_written_as_one_file(spark):
    path = written_sheets(Lines(spark))
    files = glob.glob(f"{path}/file_id=*/*.csv")
    assert len(files) == 6, len(files)
    assert len({os.path.dirname(f) for f in files}) == 6


def test_rows_find_their_headers_without_a_shuffle_of_the_rows(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text("A,B,A,\n" + "".join(f"{i},y,{name},z\n" for i in range(3)))
    (tmp_path / "head.csv").write_text("A\n")
    rows = sheets.row_maps(*sheets.read_sheets(spark, str(tmp_path), max_columns=6), file="file")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    assert rows.columns == ["file", "position", "values", "too_wide", "headers", "cells"]
    assert sorted((r.cells["A"], r.cells["B"]) for r in rows.collect()) == [("a", "y")] * 3 + [("b", "y")] * 3


def _some_sides(spark):
    crosses = spark.createDataFrame(
        [
            ("M1", "H1", "AUTO", "ACTIVE"),
            ("M1", "H2", "AUTO", " active "),
            ("M1", None, "COMMERCIAL", "ACTIVE"),
            ("M1", "H3", "COMMERCIAL", None),
            ("M2", None, None, None),
            (None, "H4", "AUTO", "ACTIVE"),
        ]
        * 2,
        "cross_ref_mpn string, house_mpn string, component_grade string, status string",
    )
    names = spark.createDataFrame([(1, "acme", "ACME 1"), (2, "acme", "ACME 2"), (3, None, "NONE")], "id bigint, original_name string, standardized_name string")
    quotes = spark.createDataFrame([("P1", None, "Q1", "m"), ("P1", "2024-01-01", "Q2", None), (None, None, "Q3", "m")], "item string, d string, quote_number string, quote_mpn string")
    aml = spark.createDataFrame([("P1", 5, 2.5), ("P1", 9, None), (None, 1, 1.0)], "item string, total_demand bigint, p double")
    return SideTables(
        references(spark),
        names,
        crosses,
        quotes.select("item", F.col("d").cast("timestamp").alias("log_date"), "quote_number", "quote_mpn"),
        aml.select("item", "total_demand", F.col("p").cast("decimal(28,10)").alias("min_price")),
    )


def test_written_side_tables_give_the_same_run(spark):
    sides = _some_sides(spark)
    kept = written_sides(sides)
    assert kept.crosses.count() == 5 and kept.quotes.count() == 1 and kept.aml.count() == 1 and kept.manufacturers.count() == 2
    facts = lambda crosses: sorted(map(str, crosses_by_mpn(crosses).collect()))
    assert facts(kept.crosses) == facts(sides.crosses) == facts(crosses_by_status(kept.crosses))
    headers = ["ITEM", "DESCRIPTION", "MFG_PARTNO", "GLOBAL_MFG_NAME", "EAU", "STD_COST"]
    files = spark.createDataFrame(
        [(f, headers, {h: h for h in headers}, f == 1, True, None) for f in (0, 1)],
        "file_id bigint, headers array<string>, mapping map<string,string>, auto_mode boolean, demand_lookup boolean, volume_multiplier int",
    )
    lines = [(f, f"{f}-{n}", n, ["P1", f"some capacitor {n} ceramic", mpn, "acme", "10", "1.5"]) for f in (0, 1) for n, mpn in enumerate(["M1", "M2", None])]
    rows = spark.createDataFrame(lines, "file_id bigint, item_id string, line_no bigint, values array<string>")

    def result(side):
        enriched = process_files(rows, files, side, stand_in_embedding).enriched
        return sorted(str(r.asDict()) for r in enriched.select(sorted(enriched.columns)).collect())

    assert len(result(kept)) == 6 and result(kept) == result(sides)


def _priced_lines(spark):
    """Items as they stand, padded, blank and null, on one line and on several; quotes of one item in two paddings."""
    items = ["P1", " P1", "P1 ", "P2", "", "  ", None, "P3", "P3", None]
    rows = [(f, f"{f}-{i}", i, item, "P2" if i % 2 else "M9", i % 3 * 10) for f in (1, 2) for i, item in enumerate(items)]
    lines = spark.createDataFrame(rows, "file_id bigint, item_id string, line_no bigint, item string, mfg_partno string, eau bigint")
    price = lambda n: F.when(F.col("line_no") % n == 0, F.col("line_no") + n).cast("decimal(28,10)")
    lines = lines.withColumns({"std_cost": price(2), "last_purchase_price": price(3), "last_po": price(5)}).withColumns(
        {"scope": F.lit("Out of scope"), "demand_lookup": F.lit(True), "grade": F.lit("AUTO")}
    )
    quotes = [("P1", "2024-01-01", "Q1"), (" P1", "2024-02-01", "Q2"), ("", "2024-03-01", "Q3"), ("P3", None, "Q4"), ("P2", "2024-01-05", "Q5")]
    quotes = spark.createDataFrame(quotes, "item string, d string, quote_number string").select(
        "item", F.col("d").cast("timestamp").alias("log_date"), "quote_number", F.lit("m").alias("quote_mpn")
    )
    aml = spark.createDataFrame([("P1", 5, 2), (" P1", 7, 1), ("", 9, 9), ("P3", 4, None), ("P9", 1, 1)], "item string, total_demand bigint, p int")
    crosses = spark.createDataFrame([("M9", "H", "AUTO", "ACTIVE")], "cross_ref_mpn string, house_mpn string, component_grade string, status string")
    return lines, quotes, aml.select("item", "total_demand", F.col("p").cast("decimal(28,10)").alias("min_price")), crosses


def test_items_find_their_quote_as_they_stand_and_their_demand_stripped(spark):
    got = {r.item_id: r for r in enrich(*_priced_lines(spark)).collect()}
    assert len(got) == 20
    for f in (1, 2):
        answers = [(r.item_quoted, r.previous_quote_number, r.total_demand, r.duplication_flag) for r in (got[f"{f}-{i}"] for i in range(10))]
        assert answers == [
            (True, "Q1", 5, "Unique"),
            (True, "Q2", 5, "Unique"),
            (False, None, 5, "Unique"),
            (True, None, None, "Unique"),  # repeats the part number
            (True, "Q3", None, "Unique"),
            (False, None, None, "Unique"),
            (False, None, None, "Unique"),
            (True, "Q4", 4, "Unique"),
            (True, "Q4", 4, "AML"),
            (False, None, None, "AML"),
        ], answers


def test_figures_shuffle_no_prices_and_items_once(spark):
    """Of three prices the lowest travels, and one lookup by item answers quotes and demand."""
    shown = enrich(*_priced_lines(spark)).select("item_id", "ear", "ear_fallback", "previously_quoted", "cross_mpn", "total_demand")
    nodes = _shuffled_columns(spark, shown)
    assert nodes and not [n for n in nodes if "std_cost" in n or "last_po" in n]
    assert sum("file_id" in n and "_k_item_key" in n for n in nodes) == 1


def test_descriptions_travel_through_one_lookup_of_edits(spark):
    lines = spark.createDataFrame([(1, "a", 1, "P1", "red box")], "file_id bigint, item_id string, line_no bigint, item string, description string")
    edits = spark.createDataFrame([(1, "a", "E")], "file_id bigint, item_id string, new_commodity string")
    nodes = _shuffled_columns(spark, line_edits_for(lines, lines, edits).select("item_id", "edited_commodity"))
    assert sum("description" in n and "_k_edit_key" in n for n in nodes) == 1


def _shuffled_columns(spark, df):
    """The input columns of every exchange of a plan without broadcasts."""
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = df._jdf.queryExecution().explainString(mode)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    return [n.split("\n")[1] for n in plan.split("\n\n") if ") Exchange\n" in n]


def test_texts_and_stored_vectors_are_shuffled_once_each_by_the_bytes_of_the_hash(spark):
    """The texts were shuffled as texts and then by the hex form of their hash."""
    rows = [(2, 1, "a", [2.0]), (1, 5, "a", [1.5]), (1, 3, " a ", [1.3]), (1, 1, "b", None), (1, 2, "c", [3.0]), (1, 4, None, [9.0]), (1, 6, "", [8.0])]
    lines = spark.createDataFrame(rows, "file_id long, line_no long, text string, embedding array<float>")
    stored = lines.withColumn("text_hash", text_hash(F.trim("text")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = reuse.reuse_embeddings(reuse.distinct_texts(lines, keyed=True), stored)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2, plan
    assert found.columns == ["text_hash", "text", "embedding"]
    assert sorted((r.text, r.embedding) for r in found.select("text", F.col("embedding")[0].alias("embedding")).collect()) == [("a", pytest.approx(1.3)), ("b", None), ("c", 3.0)]
    assert {r.text_hash for r in found.collect()} == {hashlib.sha256(t.encode()).hexdigest() for t in "abc"}
    # Hashes of another form are compared as they are: as text, not as bytes in hex.
    odd = [("h1",), ("ab" * 32,), ("AB" * 32,), ("ab" * 32 + "\n",), ("x" * 32,), (None,)]
    texts = spark.createDataFrame(odd, "text_hash string").withColumn("text", F.col("text_hash"))
    known = texts.select(F.lit(1).alias("file_id"), F.lit(1).alias("line_no"), "text_hash", F.array("text_hash").alias("embedding"))
    assert all(r.embedding == (r.text_hash and [r.text_hash]) for r in reuse.reuse_embeddings(texts, known).collect())


def test_old_lines_are_built_once_for_their_keys_and_for_the_result(spark):
    schema = "file_id long, item_id string, item string, description string"
    lines = spark.createDataFrame([(1, "n1", "P1", "red bolt"), (1, "n2", None, " gear "), (2, "n3", "a|b", None), (3, "n4", None, None)], schema)
    old = [(1, "o1", "P1", "x"), (1, "o2", "P9", "gear"), (1, "o3", "P9", "x"), (2, "o4", "a", "b"), (2, "o5", "P1", "red bolt"), (3, "o6", None, None), (None, "o7", "P1", "x"), (1, None, "P1", "x"), (1, "o1", "P7", "x")]
    rows = spark.createDataFrame(old, schema)
    kept = rows.join(spark.createDataFrame([(i,) for i in {o[1] for o in old} if i], "item_id string"), "item_id")
    found = matched_previous(lines, kept)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftSemi") == 2 and "Join Inner" not in plan, plan
    assert found.columns == ["item_id", "file_id", "item", "description"]
    assert sorted((r.item_id, r.item) for r in found.collect()) == [("o1", "P1"), ("o1", "P7"), ("o2", "P9"), ("o4", "a"), ("o6", None)]


def test_a_response_is_searched_once_for_its_error_and_its_decision(spark):
    lines = spark.createDataFrame([(1, "a", "C", "S"), (1, "b", "C", "S")], "file_id long, item_id string, commodity string, scope string")
    fenced = '```json\n{"should_correct": true, "confidence_level": "high", "recommended_commodity": "N"}\n```'
    responses = spark.createDataFrame([("a", fenced), ("b", "{no json}")], "item_id string, response_text string")
    found = review_outcomes(lines.select("item_id"), lines, responses)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("```json") == 1
    assert sorted((r.item_id, r.error, r.new_commodity) for r in found.collect()) == [("a", None, "N"), ("b", "unreadable response", None)]
