"""Scalar functions on literal tables."""

from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from partloom.functions import money, rules, scope, text, vectors
from partloom.operators import corrections


def apply(spark, fn, values, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r["r"] for r in df.select("i", fn(F.col("v")).alias("r")).orderBy("i").collect()]


@pytest.mark.parametrize("with_null", [True])
def test_clean_money(spark, with_null):
    given_to_expected = {
        "10.50": "10.5", "$1,234.50": "1234.5", "12,50": "1250", "5.": "5", ".5": "0.5", "-": "0", "": "0", " \t ": "0",
        "abc": "0", "-7": "-7", "1.2.3": "1.2", "5-3": "5", "€ 9": "9", "1e5": "15", "--5": "0", "+5": "5", "-.5": "-0.5",
    }
    got = apply(spark, money.clean_money, list(given_to_expected) + [None])
    assert got[:-1] == [Decimal(v) for v in given_to_expected.values()]
    assert got[-1] is None


def test_clean_money_beyond_the_type_is_null(spark):
    assert apply(spark, money.clean_money, ["1" * 20]) == [None]


def test_clean_quantity(spark):
    cases = {"1,000": 1, "12.9": 12, "abc": 0, "": None, "  ": None, " 42 ": 42, "-3": -3, "+4": 4, "1_000": 1000, "7 pcs": 7}
    assert apply(spark, money.clean_quantity, list(cases) + [None]) == list(cases.values()) + [None]


def test_money_column_by_type(spark):
    df = spark.sql("SELECT 1.5D AS a, date'2024-01-01' AS b, '2' AS c")
    row = df.select(*[money.money_column(df, c).alias(c) for c in "abc"]).first()
    assert [row.a, row.b, row.c] == [Decimal("1.5"), 0, 2]


def test_ear_fallbacks(spark):
    schema = "eau bigint, std_cost decimal(18,4), last_purchase_price decimal(18,4), last_po decimal(18,4), d bigint, m decimal(18,4)"
    d = Decimal
    rows = [
        (10, d("2"), d("1.5"), d("0"), 99, d("1")),
        (10, None, None, None, 99, d("1.005")),
        (0, d("2"), None, None, 7, None),
        (None, None, None, None, 7, d("3")),
        (None, d("2"), None, None, None, d("3")),
        (10, d("-1"), None, None, 7, None),
    ]
    got = spark.createDataFrame(rows, schema).select(
        money.ear(F.col("d"), F.col("m")).alias("e"), money.ear_uses_fallback(F.col("d"), F.col("m")).alias("f")
    ).collect()
    assert [r.e for r in got] == [d("15.00"), d("10.05"), d("14.00"), d("21.00"), None, None]
    assert [r.f for r in got] == [False, True, True, True, False, False]


def test_ear_status(spark):
    got = apply(spark, money.ear_status, [None, Decimal("99999.99"), Decimal("100000")], "decimal(18,2)")
    assert got == [rules.NO_EAR, rules.EAR_NOT_MET, rules.EAR_MET]


def test_scopes(spark):
    values = ["In scope", " IN SCOPE ", "in scope\t", "Out of scope", "Requires Review", "", None]
    out = [rules.IN_SCOPE] * 3 + [rules.OUT_OF_SCOPE] * 4
    assert apply(spark, scope.normalize_scope, values) == out
    twice = apply(spark, lambda c: scope.normalize_scope(scope.normalize_scope(c)), values)
    assert twice == out


@pytest.mark.parametrize(
    "base, auto, mode, expected",
    [
        ("Out of scope", "In scope", False, "Out of scope"),
        ("Out of scope", "In scope", True, "In scope"),
        ("In scope", None, True, "In scope"),
        ("In scope", " ", True, "In scope"),
        (None, None, True, "Out of scope"),
        ("In scope", "Out of scope", True, "Out of scope"),
    ],
)
def test_resolve_scope(spark, base, auto, mode, expected):
    df = spark.createDataFrame([(base, auto)], "b string, a string")
    assert df.select(scope.resolve_scope(F.col("b"), F.col("a"), F.lit(mode))).first()[0] == expected


def test_share_band(spark):
    assert apply(spark, money.share_band, [0.0, 5.0, 5.1, 15.0, 30.0, 30.1], "double") == ["0-5", "0-5", "5-15", "5-15", "15-30", ">30"]


def test_expand_description(spark):
    cases = {
        "CONN, PCB &amp; SMT": "Connector, Printed Circuit Board and Surface-Mount Technology",
        "ac/dc power": "Alternating Current / Direct Current power",
        "w-to-b conn": "Wire to Board conn",
        "VCTCXO 10MHz": "Voltage Controlled Temperature Compensated Crystal Oscillator (VCTCXO) 10MHz",
        "sensor (MEMS)": "sensor (MEMS)",
        "MEMS mic": "Micro-Electro-Mechanical Systems (MEMS) mic",
        "x\nOSC 5": "x\nOscillators 5",
        "éEV ev": "éEV Electric Vehicle",
        "a–b": "a-b",
        "SENSOR IC, DC POWER JACK": "SENSOR Integrated Circuit, Direct Current Power Jack",
        " RJ45 ": "RJ45 (8P8C Ethernet)",
        "plain": "plain",
        "  ": "",
    }
    assert apply(spark, text.expand_description, list(cases)) == list(cases.values())


def test_expansion_is_not_always_stable(spark):
    assert apply(spark, text.expansion_is_stable, ["RJ45", "GaN", "SiC", "PCB"]) == [False, False, False, True]


def test_a_long_text_is_put_in_upper_case_once_per_change(spark):
    """Every rule did so anew, and the first expansion was built three times."""
    frame = spark.createDataFrame([(" PCB",), ("PCB",), ("a RJ45",), ("𝐀RJ45 every – music",), (None,)], "v string")
    stable = frame.select(text.expansion_is_stable(F.col("v")).alias("r"))
    assert [r["r"] for r in stable.collect()] == [False, True, False, True, True]
    assert stable._jdf.queryExecution().optimizedPlan().toString().count("upper(") <= 4


def test_every_rule_fires(spark):
    samples = {
        "word": "{}", "bare": "{}", "listed": "{}", "plain": "a{}b",
    }
    literal = {r"(?:AC[-/\s]DC|AC\s+DC)": "AC DC", r"(?:DC[-/\s]DC|DC\s+DC)": "DC-DC", r"\s&\s": " & ", "[–—−]": "−", "CONN?": "CON"}
    inputs = []
    for kind, body, _ in rules.DESCRIPTION_REWRITES:
        body = literal.get(body, body.replace(r"[-\s]?", "-").replace(r"\s+", " "))
        inputs.append(samples[kind].format(body.lower() if kind != "plain" else body))
    got = apply(spark, text.expand_description, inputs)
    assert all(out != given for given, out in zip(inputs, got)), list(zip(inputs, got))


def test_texts(spark):
    df = spark.createDataFrame([(" ab-1 x! ", "M1", "PCB", " Acme ", "L1", None)], "i string, m string, d string, f string, a string, b string")
    c = F.col
    line = df.select(text.line_text(c("i"), c("m"), c("d"), c("f"), None, (c("a"), c("b")))).first()[0]
    assert line == "Product: AB-1_X\nDescription: Printed Circuit Board\nManufacturer: Acme\nMPN: M1\nCategory Hierarchy: L1"
    stored = df.select(text.stored_line_text(c("i"), c("m"), c("d"), c("f"))).first()[0]
    assert stored == "Product: _AB-1_X_\nDescription: Printed Circuit Board\nManufacturer:  Acme \nMPN: M1"


def test_small_text_functions(spark):
    assert apply(spark, text.estimated_tokens, ["x" * 40, "hola", "", None]) == [10, 1, 0, 0]
    assert apply(spark, text.sample_cell, ["x" * 101, "y" * 100]) == ["x" * 100 + "...", "y" * 100]
    assert apply(spark, text.sample_mpns, ["a,b,c,d", "a", None]) == ["a, b, c", "a", "None"]
    assert apply(spark, text.has_little_context, ["short", "abcdefghijk", "resistor 1k ohm smd"]) == [True, True, False]
    assert apply(spark, text.is_blank, [None, "", " \t\n", " ", "0", "a"]) == [True] * 4 + [False] * 2


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0], [1.0], None)], "a array<float>, b array<float>, c array<float>, n array<float>")
    c = F.col
    row = df.select(
        vectors.dot(c("a"), c("b")), vectors.dot(c("a"), c("c")), vectors.dot(c("a"), c("n")), vectors.cosine(c("a"), c("a"))
    ).first()
    assert row[0] == 11.0 and row[1] == 0.0 and row[2] == 0.0 and abs(row[3] - 1) < 1e-12
    dims = spark.range(1).select(F.size(vectors.stand_in_embedding(F.lit("x"), 1536))).first()[0]
    assert dims == 1536


def test_decisions(spark):
    good = '{"should_correct": true, "confidence_level": "high", "recommended_commodity": "A", "recommended_scope": "In scope"}'
    cases = [f"text\n```json\n{good}\n```\nend {{}}", f"tail {good} x", "nothing", "```json {broken} ```", "{not json}", None]
    got = apply(spark, corrections.parse_decision, cases)
    assert [g.should_correct for g in got] == [True, True, False, False, False, False]
    assert [g.confidence_level for g in got] == ["high", "high", "low", "low", "low", "low"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=60), min_size=20, max_size=60))
def test_any_text_has_a_decision_and_a_number(spark, texts):
    assert all(d is not None for d in apply(spark, corrections.parse_decision, texts))
    assert all(n is not None for n in apply(spark, money.clean_money, texts))
