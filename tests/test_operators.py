"""Operators on small fixtures, against brute force where SQL has no equivalent."""

from decimal import Decimal

import numpy as np
from pyspark.sql import functions as F

from partloom.functions.vectors import stand_in_embedding
from partloom.operators import mapping, nearest, remap, sessions
from partloom.operators.lookup import item_facts, quote_columns, with_commodity, with_item_facts
from partloom.plans.enrich import enrich
from partloom.plans.process import SideTables
from partloom.sources import catalogue, sheets, side_tables
from partloom.streaming.uploads import upload_stream

REFERENCES = [
    # id, global code, level 1, level 2, level 3, base, auto
    (1, "PACKAGING", "INDIRECT MATERIALS", "PACKAGING", "PACK BROWN BOX", "In Scope", None),
    (2, "PACKAGING", "INDIRECT MATERIALS", "PACKAGING", "PACK LABELS", "In Scope", None),
    (3, "PACKAGING", "INDIRECT MATERIALS", "PACKAGING", "PACKAGING PREMIUM", "In Scope", None),
    (4, "HARDWARE", "DIRECT MATERIALS", "HARDWARE", "HARDWARE", "Out of scope", None),
    (5, "AUTO PARTS", "DIRECT MATERIALS", "AUTOMOTIVE", "AUTO COMPONENT", "Out of scope", "In scope"),
]


def references(spark):
    from partloom.functions.text import reference_text

    df = spark.createDataFrame(
        REFERENCES, "id bigint, global_code string, level1 string, level2 string, level3 string, base_scope string, auto_scope string"
    )
    for c in ("level3_expanded", "keyword", "mfr", "typical_mpns"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    return df.withColumn("embedding", stand_in_embedding(reference_text()))


def empty(spark, schema):
    return spark.createDataFrame([], schema)


def sides(spark, crosses=()):
    return SideTables(
        references(spark),
        empty(spark, "original_name string, standardized_name string"),
        spark.createDataFrame(
            list(crosses),
            "cross_ref_mpn string, supplier_pn string, house_mpn string, house_cost decimal(18,4), cross_ref_mfg string, component_grade string, status string",
        ),
        empty(spark, "item string, log_date timestamp, quote_number string, quote_mpn string"),
        empty(spark, "item string, total_demand bigint, min_price decimal(18,4)"),
    )


def test_nearest_equals_brute_force_for_any_block_size(spark):
    rng = np.random.default_rng(7)
    refs, lines = rng.normal(size=(90, 8)), rng.normal(size=(70, 8))
    refs[10] = refs[3]  # a tie
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = np.round(unit(lines) @ unit(refs).T, 12)
    expected = {(i, int(j), r + 1) for i in range(70) for r, j in enumerate(np.argsort(-sims[i], kind="stable")[:5])}
    ref_df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(refs)] + [(999, None), (998, [0.0] * 8)], "ref_id bigint, vec array<double>")
    line_df = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(lines)] + [(500, None), (501, [1.0, 2.0]), (502, [0.0] * 8)], "key bigint, vec array<double>"
    ).repartition(5)
    for block_bytes, group in ((1 << 20, 16), (1500, 16), (300, 2)):
        found = nearest.nearest_references(line_df, ref_df, 5, block_bytes, group).collect()
        one = nearest.nearest_references(line_df, ref_df, 1, block_bytes, group).collect()
        assert {(r["key"], r["ref_id"], r["rank"]) for r in one} == {e for e in expected if e[2] == 1}
        assert {(r["key"], r["ref_id"], r["rank"]) for r in found} == expected


def test_best_k_on_wide_blocks_keeps_ties_in_order():
    values = np.zeros((2, 5000))
    values[0, [4000, 17, 2500]] = [0.5, 0.5, 0.9]
    assert nearest.best_k(values, 4)[0].tolist() == [2500, 17, 4000, 0]
    assert nearest.best_k(values, 3)[1].tolist() == [0, 1, 2]


def test_identify_columns(spark):
    headers = ["ITEM", "DESCRIPTION", "MFG_PARTNO", "USD_STD_COST", "LEVEL3_DESC"]
    df = spark.createDataFrame([(1, i, h) for i, h in enumerate(headers)], "file_id bigint, pos int, header string")
    got = mapping.identify_columns(df).first()["mapping"]
    assert got == {
        "ITEM": "ITEM", "DESCRIPTION": "DESCRIPTION", "MFG_PARTNO": "MFG_PARTNO", "GLOBAL_MFG_NAME": "MFG_PARTNO", "STD_COST": "USD_STD_COST",
    }


def test_hierarchy_detection_needs_matching_values(spark):
    headers = spark.createDataFrame([(1, 0, "Level 3"), (1, 1, "my_level3"), (2, 0, "level3")], "file_id bigint, pos int, header string")
    values = [(1, "Level 3", "nothing"), (1, "my_level3", "pack  brown box"), (1, "my_level3", "HARDWARE"), (1, "my_level3", "other"), (2, "level3", "a"), (2, "level3", "HARDWARE")]
    samples = spark.createDataFrame(values, "file_id bigint, header string, value string")
    found = mapping.detect_hierarchy_column(headers, samples, references(spark), "LEVEL3_DESC").collect()
    assert [(r.file_id, r.header) for r in found] == [(1, "my_level3")]
    nothing = references(spark).where("id < 0")
    first = mapping.detect_hierarchy_column(headers, samples, nothing, "LEVEL3_DESC").collect()
    assert {(r.file_id, r.header) for r in first} == {(1, "Level 3"), (2, "level3")}


def test_one_item_on_most_lines_has_one_first_line(spark):
    """Also a null item: it counts as one value."""
    rows = [(1, f"a{i}", i, "HOT" if i % 3 else None) for i in range(3000)]
    lines = spark.createDataFrame(rows, "file_id bigint, item_id string, line_no bigint, item string")
    quotes = side_tables.latest_quotes(empty(spark, "item string, log_date timestamp, quote_number string, quote_mpn string"))
    demand = side_tables.demand_by_item(empty(spark, "item string, total_demand bigint, min_price decimal(18,4)"))
    joined = with_item_facts(lines, item_facts(lines, quotes, demand))
    first = joined.where(F.col("line_no") == F.col("first_line_no")).select("item_id").collect()
    assert joined.count() == 3000 and sorted(r.item_id for r in first) == ["a0", "a1"]


def test_quote_guard(spark):
    rows = [("A", "B", True), ("A", "A", True), ("A", None, False), (" ", "B", True)]
    df = spark.createDataFrame(rows, "item string, mpn string, hit boolean").withColumns(
        {"log_date": F.when(F.col("hit"), F.current_timestamp()), "quote_number": F.lit("q"), "quote_mpn": F.lit("m")}
    )
    got = df.withColumns(quote_columns(F.col("item"), F.col("mpn"))).collect()
    assert [r.previously_quoted for r in got] == ["YES", "NO", "NO", None]


def test_demand_only_for_files_that_asked(spark):
    lines = spark.createDataFrame(
        [(1, "a", 1, "PKG-001", False), (2, "b", 1, "PKG-001", True)], "file_id bigint, item_id string, line_no bigint, item string, demand_lookup boolean"
    ).withColumns(
        {
            "mfg_partno": F.lit(None).cast("string"), "grade": F.lit("COMMERCIAL"), "scope": F.lit("In scope"),
            "eau": F.lit(None).cast("bigint"), **{c: F.lit(None).cast("decimal(18,4)") for c in ("std_cost", "last_purchase_price", "last_po")},
        }
    )
    aml = spark.createDataFrame([("PKG-001", 50000, 15.5)], "item string, total_demand bigint, p double").select(
        "item", "total_demand", F.col("p").cast("decimal(18,4)").alias("min_price")
    )
    s = sides(spark)
    got = {r.file_id: r for r in enrich(lines, s.quotes, aml, s.crosses).collect()}
    assert got[1].total_demand is None and got[1].ear is None
    assert got[2].total_demand == 50000 and float(got[2].ear) == 775000.0 and got[2].ear_fallback


def test_lookup_ignores_case_and_takes_lowest_id(spark):
    refs = references(spark).unionByName(references(spark).where("id = 1").withColumns({"id": F.lit(9).cast("bigint"), "level3": F.lit("pack brown box")}))
    names = spark.createDataFrame([("x", " Pack Brown Box "), ("y", "none")], "item_id string, name string")
    got = {r.item_id: r.reference for r in with_commodity(names, refs, F.col("name")).collect()}
    assert got["x"]["id"] == 1 and got["y"] is None


def test_first_edited_key_decides(spark):
    old = spark.createDataFrame(
        [(1, "o1", 1, "A", "red box"), (1, "o2", 2, "B", "blue box"), (1, "o3", 3, None, "grey"), (2, "o4", 1, "A", "red box"), (1, "o5", 9, "A", "x")],
        "file_id bigint, item_id string, line_no int, item string, description string",
    )
    edits = spark.createDataFrame([(1, "o1", "E1"), (1, "o2", "E2"), (1, "o3", "E3"), (2, "o4", " "), (1, "o5", "E5")], "file_id bigint, item_id string, new_commodity string")
    new = [(1, "n1", "A", "blue box"), (1, "n2", "C", " red box "), (1, "n3", None, "grey"), (2, "n4", "A", "red box"), (1, "n5", None, None), (1, "n6", "", "|grey")]
    lines = spark.createDataFrame(new + [(1, f"m{k}", f"Z{k}", f"other {k}") for k in range(50)], "file_id bigint, item_id string, item string, description string")
    got = {r.item_id: r.edited_commodity for r in remap.line_edits_for(lines, old, edits).collect()}
    assert len(got) == 56 and {k: v for k, v in got.items() if v} == {"n1": "E1", "n2": "E1", "n3": "E3", "n6": "E3"}  # one name space of keys
    none = remap.line_edits_for(lines, old.limit(0), edits)
    assert none.count() == 56 and none.where("edited_commodity IS NOT NULL").count() == 0


def test_bulk_change_keeps_blank_targets(spark):
    lines = spark.createDataFrame(
        [(1, "a", "PACK BROWN BOX"), (1, "b", "PACK LABELS")], "file_id bigint, item_id string, commodity string"
    ).withColumns({"scope": F.lit("x"), "auto_mode": F.lit(False)})
    changes = spark.createDataFrame([(1, "PACK BROWN BOX", "HARDWARE"), (1, "PACK LABELS", "")], "file_id bigint, old_commodity string, new_commodity string")
    got = {r.item_id: (r.commodity, r.scope) for r in remap.remap_lines(lines, references(spark), changes=changes).collect()}
    assert got == {"a": ("HARDWARE", "Out of scope"), "b": ("PACK LABELS", "x")}


def test_failed_load_keeps_the_old_catalogue(spark, tmp_path):
    target = str(tmp_path / "catalogue")
    raw = references(spark).select(*catalogue.REFERENCE_COLUMNS)
    assert catalogue.replace_catalogue(raw, target).count == 5
    bad = raw.withColumn("auto_scope", F.lit("maybe"))
    result = catalogue.replace_catalogue(bad, target)
    assert not result.success and "autograde" in result.error
    assert spark.read.parquet(target).count() == 5


def test_sheet_reader_takes_last_of_repeated_headers_and_odd_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Item,Note,Item,\nA,"x, ""y""",B,z\nC,,D,\n')
    (tmp_path / "b.CSV").write_text("Other\n1\n")
    (tmp_path / "c.xls").write_text("junk")
    rows, headers = sheets.read_sheets(spark, str(tmp_path), max_columns=5)
    maps = sheets.row_maps(rows, headers, "file").select(F.element_at(F.split("file", "/"), -1).alias("f"), "cells").collect()
    assert sorted((r.f, tuple(sorted(r.cells.items(), key=str))) for r in maps) == [
        ("a.csv", (("Item", "B"), ("Note", 'x, "y"'))),
        ("a.csv", (("Item", "D"), ("Note", None))),
        ("b.CSV", (("Other", "1"),)),
    ]
    errors = [r.error_message for r in sheets.sheet_files(spark, str(tmp_path)).collect() if r.error_message]
    assert errors == ["Unsupported file format: c.xls"]


def test_close_is_idempotent_and_never_negative(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (1, timestamp'2024-01-02 00:00:00', NULL, NULL, NULL), (2, timestamp'2024-01-01 00:00:00', timestamp'2024-01-01 01:00:00', 3600, 'manual') "
        "AS t(session_id, started_at, ended_at, duration_seconds, sign_out_reason)"
    ).withColumns({"ended_at": F.col("ended_at").cast("timestamp"), "duration_seconds": F.col("duration_seconds").cast("bigint"), "sign_out_reason": F.col("sign_out_reason").cast("string")})
    got = {r.session_id: r for r in sessions.close_sessions(df, F.lit("2024-01-01 12:00:00").cast("timestamp"), "forced").collect()}
    assert got[1].duration_seconds == 0 and got[1].sign_out_reason == "forced"
    assert got[2].duration_seconds == 3600 and got[2].sign_out_reason == "manual"


def test_session_times(spark):
    df = spark.createDataFrame(
        [(1, "2024-01-01", 3600), (1, "2024-01-01", 1800), (1, None, None)], "user_id bigint, ended_at string, duration_seconds bigint"
    )
    row = sessions.session_times(df).first()
    assert (row.average_seconds, row.total_seconds) == (2700.0, 5400)


def test_uploads_are_processed_once(spark, tmp_path):
    inbox, target = tmp_path / "inbox", str(tmp_path / "out")
    inbox.mkdir()
    (inbox / "one.csv").write_text(
        "ITEM,DESCRIPTION,MFG_PARTNO,USD_STD_COST,LEVEL3_DESC\n"
        "ITEM001,packaging labels adhesive premium quality,PKG-001,10.50,PACK LABELS\n"
        "ITEM002,brown cardboard shipping box medium size,PKG-002,15.75,PACK BROWN BOX\n"
        "ITEM003,stainless steel bolt hardware fastener,HW-001,5.25,HARDWARE\n"
    )
    (inbox / "bad.csv").write_text("ITEM,DESCRIPTION,PARTNO\n,text,\nA,text,B\n")
    cross = [("HW-001", "S", "H1", None, "M", "COMMERCIAL", "OBSOLETE")]

    def run():
        stream = upload_stream(spark, str(inbox), target, lambda: sides(spark, cross), str(tmp_path / "cp"), stand_in_embedding, max_columns=8)
        stream.trigger(availableNow=True).start().awaitTermination()

    run()
    first = {r["item"]: (r.commodity, r.scope, float(r.std_cost)) for r in spark.read.parquet(f"{target}/lines").collect()}
    assert first == {
        "ITEM001": ("PACK LABELS", "In scope", 10.5),
        "ITEM002": ("PACK BROWN BOX", "In scope", 15.75),
        "ITEM003": ("HARDWARE", "In scope", 5.25),
    }
    status = sorted((r.status, r.error_message) for r in spark.read.parquet(f"{target}/status").collect())
    assert status == [("completed", None), ("failed", "item missing")]
    (inbox / "two.csv").write_text("item no,desc\nX1,some capacitor 10uF ceramic\n")
    run()
    lines = spark.read.parquet(f"{target}/lines")
    assert lines.count() == 4
    assert lines.where("item = 'X1'").first().commodity in {r[4] for r in REFERENCES}


def test_null_keys_are_spread_over_the_shuffle(spark):
    """Most lines without a part number must not meet in one partition of the join."""
    from partloom.operators.lookup import lookup

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lines = spark.range(4000).select(F.col("id").cast("string").alias("item_id"), F.when(F.col("id") % 10 == 0, F.col("id")).alias("mpn"))
        side = spark.range(0, 4000, 20).select(F.col("id").alias("k"), F.lit("hit").alias("v"))
        out = lookup(lines, side, {"k": F.col("mpn")})
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert out.where("v = 'hit'").count() == 200 and out.count() == 4000
        assert len(sizes) == 8 and max(sizes) < 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_best_cross_of_each_grade(spark):
    schema = "cross_ref_mpn string, supplier_pn string, house_mpn string, house_cost decimal(28,10), cross_ref_mfg string, component_grade string"
    crosses = [("P", "S1", "H1", 5, "M", "COMMERCIAL"), ("P", "S1", "H2", 3, "M", "AUTO"), ("P", "S1", "H3", 4, "M", "AUTO"), ("P", "S0", " ", 1, "M", "AUTO"), ("P", "S0", "H4", 1, "M", None)]
    crosses = [(a, b, c, Decimal(d), e, f) for a, b, c, d, e, f in crosses]
    got = side_tables.best_cross_by_grade(spark.createDataFrame(crosses, schema)).collect()
    assert sorted((r["cross_ref_mpn"], r["component_grade"], r["house_mpn"]) for r in got) == [("P", "AUTO", "H2"), ("P", "COMMERCIAL", "H1")]


def test_old_lines_of_files_in_either_mode_are_matched(spark):
    from __spark_entry__ import queries

    sf = "/root/testdata/sf0.001"
    every, auto = ({r["old_id"] for r in queries()[q](spark, sf).collect()} for q in ("U1_matched_by_all_lines", "U1_matched_old_lines"))
    assert auto < every
