"""Stored versions, status life cycle, review outcomes."""

import random

import pytest

from partloom.functions import rules
from partloom.operators import corrections, sessions
from partloom.sources import sinks

LINES = "file_id bigint, item_id string, line_no bigint, commodity string"


def stored(spark, path):
    return sorted((r.file_id, r.item_id, r.commodity) for r in sinks.published(spark, path).collect())


def test_former_lines_stay_until_the_pointer_moves(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    with pytest.raises(ValueError):
        sinks.published(spark, path)
    sinks.publish(spark.createDataFrame([(1, "a", 1, "old"), (2, "b", 1, "old")], LINES), path)
    first = [(1, "a", "old"), (2, "b", "old")]
    again = sinks.published(spark, path).where("file_id = 1").withColumn("commodity", sinks.F.lit("new"))
    with monkeypatch.context() as stop:
        def fail(*_):
            raise RuntimeError("stopped")

        stop.setattr(sinks, "_point", fail)
        with pytest.raises(RuntimeError):
            sinks.publish(again, path)
    assert stored(spark, path) == first  # written, but not yet pointed at
    before = sinks.published(spark, path)
    assert sinks.publish(again, path) == 2  # the number of the stopped run is not used again
    assert stored(spark, path) == [(1, "a", "new"), (2, "b", "old")]
    assert sorted((r.file_id, r.commodity) for r in before.collect()) == [(1, "old"), (2, "old")]  # an open reader keeps its version


def test_status_of_long_histories(spark):
    """Random events over many days against a plain walk; one file owns most of them."""
    rng = random.Random(3)
    events = [(rng.choice([1, 1, 1, 2, 3]), f"2024-01-{rng.randrange(1, 29):02} {rng.randrange(24):02}:{rng.randrange(60):02}:{rng.randrange(60):02}", n, rng.choice([*rules.FILE_STATUSES, "lost", None])) for n in range(600)]
    df = spark.createDataFrame(events, "file_id bigint, at string, n bigint, status string").selectExpr("file_id", "cast(at AS timestamp) AS ts", "n", "status")
    got = {r.n: (r.before, r.legal) for r in sessions.status_history(df).collect()}
    order = lambda e: (e[1], rules.FILE_STATUSES.index(e[3]) if e[3] in rules.FILE_STATUSES else -1)
    last = {}
    for file, _, n, status in sorted(events, key=order):
        state = last.get(file)
        legal = status in rules.STATUS_AFTER[state]
        assert got[n] == (state, legal), n
        if legal:
            last[file] = status
    now, illegal = sessions.legal_status(df)
    assert {r.file_id: r.status for r in now.collect()} == last
    assert illegal.count() == sum(not legal for _, legal in got.values())


def test_every_asked_line_has_an_outcome(spark):
    lines = spark.createDataFrame([(1, "a", "C", "Out of scope"), (1, "b", "C", "Out of scope"), (1, "c", "C", "Out of scope"), (1, "d", "C", "Out of scope")], "file_id bigint, item_id string, commodity string, scope string")
    good = '{"should_correct": true, "confidence_level": "high", "recommended_commodity": "N", "recommended_scope": "In scope"}'
    responses = spark.createDataFrame([("a", good), ("b", "no idea"), ("d", good.replace("high", "low")), ("z", good)], "item_id string, response_text string")
    asked = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("d",), ("gone",), (None,)], "item_id string")
    got = {r.item_id: (r.success, r.error, r.correction_applied, r.new_commodity) for r in corrections.review_outcomes(asked, lines, responses).collect()}
    assert got == {
        "a": (True, None, True, "N"),
        "b": (False, "unreadable response", False, None),
        "c": (False, "no response", False, None),
        "d": (True, None, False, None),
        "gone": (False, "line not found", False, None),
        None: (False, "line not found", False, None),
    }
