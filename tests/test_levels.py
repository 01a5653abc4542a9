from decimal import Decimal

from partloom.functions import rules
from partloom.operators import analytics

ENRICHED = "file_id bigint, commodity string, item string, line_no bigint, scope string, item_quoted boolean, ear decimal(38,2), duplication_flag string"


def test_lines_are_enriched_once(spark, tmp_path):
    """Both readers, commodities and sums, take a written table: the enriched lines are not built a second time."""
    rows = [
        (1, "Bolt", "a", 1, "In scope", False, 200000, rules.FIRST_FLAG),
        (1, "Bolt", " a ", 2, "In scope", False, None, rules.FIRST_FLAG),
        (1, "Bolt", None, 3, None, True, 7, rules.REPEAT_FLAG),
        (1, None, "b", 4, None, False, 3, rules.FIRST_FLAG),
        (1, "nut", "b", 5, "Out of scope", False, 5, rules.REPEAT_FLAG),  # never first: its level stays unknown
        (2, "BOLT ", "b", 6, "out", True, 150000, rules.FIRST_FLAG),
    ]
    made = spark.createDataFrame([(*r[:6], None if r[6] is None else Decimal(r[6]), r[7]) for r in rows], ENRICHED)
    made.write.parquet(str(tmp_path / "enriched"))
    references = spark.createDataFrame(
        [(1, "Metal", "bolt", None, None), (2, "Plastic", "nut", None, None)], "id bigint, level1 string, level3 string, base_scope string, auto_scope string"
    )
    summary = analytics.level1_summary(spark.read.parquet(str(tmp_path / "enriched")), references)
    assert not [f for f in summary.inputFiles() if "/enriched/" in f]
    got = {(r["file_id"], r["level1"]): tuple(r[c] for c in ("parts", "total_ear", "in_scope_ear", "threshold_ear")) for r in summary.collect()}
    unknown = rules.UNKNOWN_LEVEL1
    assert got == {
        (1, "Metal"): (2, Decimal(200007), Decimal(200007), Decimal(200000)),
        (1, unknown): (1, Decimal(8), Decimal(0), Decimal(0)),
        (1, "Total"): (3, Decimal(200015), Decimal(200007), Decimal(200000)),
        (2, "Metal"): (1, Decimal(150000), Decimal(150000), Decimal(150000)),
        (2, "Total"): (1, Decimal(150000), Decimal(150000), Decimal(150000)),
    }
