"""Inputs that once lost data, stopped a run or multiplied lines."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from partloom import session
from partloom.functions import money
from partloom.functions.vectors import stand_in_embedding
from partloom.operators import corrections, lookup, nearest, reuse
from partloom.operators.mapping import line_problems
from partloom.sources import sheets
from partloom.streaming.uploads import upload_stream


@pytest.mark.parametrize(("text", "want"), [("0.00035", "0.00035"), ("$0.00004", "0.00004"), ("123456789012345", "123456789012345"), ("9" * 30, None)])
def test_prices_keep_their_decimals(spark, text, want):
    got = spark.createDataFrame([(text,)], "c string").select(money.clean_money(F.col("c")).alias("p")).first()["p"]
    assert got == (None if want is None else Decimal(want))


def test_revenue_is_rounded_once_and_never_ends_the_run(spark):
    rows = [(1000, "0.00035", "0.35"), (3, "0.3349999999", "1.00"), (9 * 10**18, "3", None), (2, "1.005", "2.01"), (9 * 10**18, "999999999999999999", None)]
    df = spark.createDataFrame([(q, Decimal(p)) for q, p, _ in rows], "eau bigint, std_cost decimal(28,10)")
    df = df.withColumns({c: F.lit(None).cast(money.PRICE_TYPE) for c in ("last_purchase_price", "last_po")})
    got = [r["e"] for r in df.select(money.ear(F.lit(None).cast("bigint"), F.lit(None).cast(money.PRICE_TYPE)).alias("e")).collect()]
    assert got[:2] == [Decimal("0.35"), Decimal("1.00")] and got[2] == Decimal(27 * 10**18) and got[3] == Decimal("2.01") and got[4] is None


def test_a_quantity_that_overflows_fails_its_line_only(spark):
    df = spark.createDataFrame([(9 * 10**18, 4), (5, 4), (5, None)], "q bigint, m int")
    assert [r[0] for r in df.select(money.apply_multiplier(F.col("q"), F.col("m"))).collect()] == [None, 20, 5]


def test_sheets_keep_line_breaks_and_flag_wide_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text('ITEM,DESC,N\nA,"two\nlines",1\n1,2,3,,5\n4,5,6,\n7,"",\n')
    rows, _ = sheets.read_sheets(spark, str(tmp_path), max_columns=3)
    got = {tuple(r["values"]): r["too_wide"] for r in rows.collect()}
    assert got == {("A", "two\nlines", "1"): False, ("1", "2", "3"): True, ("4", "5", "6"): True, ("7", None, None): False}


def test_a_wide_record_is_a_problem_of_its_line(spark):
    names = [f"raw_{c}" for c in ("std_cost", "last_purchase_price", "last_po", "eau")] + ["item", "description"]
    df = spark.range(1).select(*[F.lit("1").alias(n) for n in names], *[F.lit(1).alias(c) for c in ("std_cost", "last_purchase_price", "last_po", "eau")])
    assert df.select(line_problems(F.lit(True)).alias("p")).first()["p"] == ["record too wide"]
    assert df.select(line_problems().alias("p")).first()["p"] == []


def test_references_of_another_length_do_not_empty_the_answer(spark):
    refs = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)] + [(9, [1.0, 0.0, 0.0])], "ref_id bigint, vec array<double>")
    asked = spark.createDataFrame([(1, [4.0, 1.0]), (2, [2.0, 0.1, 0.0]), (3, [1.0])], "key bigint, vec array<double>")
    assert {r["key"]: r["ref_id"] for r in nearest.nearest_references(asked, refs).collect()} == {1: 4, 2: 9}


def test_the_last_response_decides(spark):
    text = '{{"should_correct": {0}, "confidence_level": "high", "recommended_commodity": "{1}", "recommended_scope": "s"}}'
    responses = spark.createDataFrame([("a", text.format("true", "X"), 1), ("a", text.format("true", "Y"), 2), (None, "x", 1)], "item_id string, response_text string, response_no int")
    lines = spark.createDataFrame([("a", "c", "o"), ("b", "c", "o")], "item_id string, commodity string, scope string")
    got = corrections.apply_corrections(lines, corrections.parsed_decisions(responses)).collect()
    assert sorted((r["item_id"], r["commodity"]) for r in got) == [("a", "Y"), ("b", "c")]


def test_a_quote_without_date_is_a_quote(spark):
    df = spark.createDataFrame([("i", "m", True, None, "Q1", "p"), ("i", "i", True, None, "Q1", "p"), ("i", "m", None, None, None, None)], "item string, mpn string, item_quoted boolean, log_date date, quote_number string, quote_mpn string")
    got = df.select(lookup.quote_columns(F.col("item"), F.col("mpn"), F.col("item_quoted"))["previously_quoted"].alias("q")).collect()
    assert [r["q"] for r in got] == ["YES", "NO", "NO"]


def test_minutes_are_filled_in_order(spark):
    texts = spark.createDataFrame([(f"{i:064x}", "x" * 4 * n) for i, n in enumerate((40, 50, 20, 300, 10, 10))], "text_hash string, text string")
    got = reuse.work_plan(texts, per_request=1, tokens_per_minute=100).orderBy("batch").collect()
    assert [(r["tokens"], r["minute"]) for r in got] == [(40, 0), (50, 0), (20, 1), (300, 2), (10, 3), (10, 3)]


def test_scratch_tables_go_when_the_block_ends(spark):
    with session.scratch(spark):
        table = session.written(spark.range(3), "some")
        assert table.count() == 3
        path = table.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(path).count()


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = staticmethod(Conf)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Cluster())


def test_every_upload_gets_a_status(spark, tmp_path):
    from registry.domain import Domain

    landing = tmp_path / "in"
    landing.mkdir()
    (landing / "good.csv").write_text("ITEM,DESCRIPTION,MFG_PARTNO\nA,part,M1\n")
    (landing / "header.csv").write_text("ITEM,DESCRIPTION\n")
    (landing / "book.xls").write_text("binary")
    sides = Domain(spark, "/root/testdata/sf0.001").sides
    stream = upload_stream(spark, str(landing), str(tmp_path / "out"), lambda: sides, str(tmp_path / "cp"), stand_in_embedding, max_columns=8)
    stream.trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["status"], r["error_message"]) for r in spark.read.parquet(str(tmp_path / "out/status")).collect())
    assert sorted(got, key=str) == [("completed", None), ("completed", None), ("failed", "Unsupported file format: book.xls")]
    assert spark.read.parquet(str(tmp_path / "out/lines")).count() == 1
