import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sluice import schemas
from sluice.operators import requests as R
from sluice.operators.skew import attach_counted
from sluice.sources.store import requests_scan, upsert_requests, write_version
from sluice.sources.workspace import new_folder

START = datetime(2026, 1, 1)


def _requests(spark, rows):
    """(id, state, category, priority, area, minutes)."""
    data = [
        (i, f"text {i}", state, None, None, None, c, p, a, None, START + timedelta(minutes=m), START, None, None)
        for i, state, c, p, a, m in rows
    ]
    return spark.createDataFrame(data, schemas.REQUEST)


LISTED = [
    ("A", "completed", "bug", "alta", "backend", 0), ("B", "completed", "datos", "media", "data", 0),
    ("C", "completed", "datos", "media", "backend", 0), ("D", "completed", "bug", "alta", "backend", 0),
    ("E", "processing", None, None, None, 9), ("F", "completed", "bug", "baja", "data", -5),
]


def _ids(df):
    return [row.id for row in df.collect()]


def test_listing_order_filters_and_pages(spark):
    table = _requests(spark, LISTED)
    assert _ids(R.list_requests(table)) == ["D", "C", "B", "A", "F"]
    assert _ids(R.list_requests(table, category="datos")) == ["C", "B"]
    assert _ids(R.list_requests(table, priority="media", area="data")) == ["B"]
    assert _ids(R.list_requests(table, limit=2, offset=1)) == ["C", "B"]
    assert _ids(R.list_requests(table, offset=20)) == []
    assert _ids(R.list_after(table, START, "C", limit=2)) == ["B", "A"]


@pytest.mark.parametrize("wrong", [{"limit": 0}, {"limit": 101}, {"limit": True}, {"offset": -1}, {"offset": True}, {"category": "x"}, {"area": "alta"}])
def test_listing_refuses_wrong_arguments(spark, wrong):
    with pytest.raises(ValueError):
        R.list_requests(_requests(spark, LISTED), **wrong)


def test_filters_reach_the_scan(spark):
    path = new_folder(spark, "pushdown")
    write_version(_requests(spark, LISTED), path)
    plan = R.completed_matching(requests_scan(spark, path), "datos").select("id")._jdf.queryExecution().toString()
    assert "EqualTo(state,completed)" in plan and "EqualTo(effective_cat" in plan
    assert "raw_message" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize("hot_rows", [3, 1_000_000])
def test_intake_with_a_hot_id_equals_one_by_one(spark, hot_rows):
    dice = random.Random(3)
    rows = [(dice.choice(["hot"] * 5 + [f"k{n}" for n in range(20)]), dice.choice(["a", "b", "a ", "A"]), n) for n in range(400)]
    stored = {"k1": ("a", "completed"), "k2": ("b", "failed"), "k3": ("A", "processing"), "other": ("a", "completed")}
    seen, expected = {}, {}
    for i, text, n in rows:
        if i in stored:
            owner, state = stored[i]
            outcome = {"completed": "duplicate_completed", "failed": "failed_terminal", "processing": "in_progress"}[state]
            expected[n] = outcome if owner == text else "conflict"
        elif i not in seen:
            seen[i], expected[n] = text, "created"
        else:
            expected[n] = "duplicate" if seen[i] == text else "conflict"
    submissions = spark.createDataFrame(rows, "id string, raw_message string, arrival long").repartition(5)
    known = spark.createDataFrame([(k, *v) for k, v in stored.items()], "id string, raw_message string, state string")
    found = R.intake(submissions, ["arrival"], known, hot_rows=hot_rows).collect()
    assert {row.arrival: row.outcome for row in found} == expected
    assert len(found) == 400 and len(set(expected.values())) == 6


def test_intake_of_repeated_blank_and_twice_stored_rows(spark):
    rows = [("a", "x", 1), ("a", "x", 1), ("a", "y", 1), (None, "x", 1), ("b", None, 1), ("b", "z", 2), ("b", "z", 2), (" ", "x", 1), ("s", "q", 1)]
    submissions = spark.createDataFrame(rows, "id string, raw_message string, arrival int")
    known = spark.createDataFrame([("s", "q", "completed")] * 2, "id string, raw_message string, state string")
    found = sorted((r.id or "", r.raw_message or "", r.outcome) for r in R.intake(submissions, ["arrival"], known).collect())
    assert found == sorted([
        ("a", "x", "created"), ("a", "x", "duplicate"), ("a", "y", "conflict"), ("", "x", "invalid"), ("b", "", "invalid"),
        ("b", "z", "created"), ("b", "z", "duplicate"), (" ", "x", "invalid"), ("s", "q", "duplicate_completed"),
    ])


def test_hot_keys_are_spread_over_salts(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 900, 0).otherwise(F.col("id")).alias("k"), "id")
    keys = rows.select("k").distinct().withColumn("v", F.col("k") * 2)
    joined = attach_counted(rows, keys, ["k"], ["id"], hot_rows=50)
    assert joined.where(F.col("v") == F.col("k") * 2).count() == 1000


def test_lifecycle_moves_processing_rows_once(spark):
    table = spark.createDataFrame([("p", "processing"), ("q", "processing"), ("c", "completed"), ("f", "failed")], "id string, state string")
    events = [
        ("p", "completed", None, 1), ("p", "failed", "timeout", 2), ("q", "failed", "refusal", 5), ("q", "completed", None, 6),
        ("c", "failed", "timeout", 1), ("f", "completed", None, 1), ("x", "completed", None, 1),
    ]
    events = spark.createDataFrame(events, "id string, target string, failure_code string, at long")
    for hot_rows in (1, 1_000_000):
        moved, routed = R.lifecycle(table, events, ["at"], hot_rows=hot_rows)
        assert {row.id: (row.state, row.new_failure_code) for row in moved.collect()} == {
            "p": ("completed", None), "q": ("failed", "refusal"), "c": ("completed", None), "f": ("failed", None),
        }
        assert Counter(row.verdict for row in routed.collect()) == {"applied": 2, "not_processing": 4, "not_found": 1}


def test_upsert_keeps_finished_rows(spark):
    stored = _requests(spark, [("A", "completed", "bug", "alta", "data", 0), ("E", "processing", None, None, None, 0)])
    reserved = spark.createDataFrame([("A", "other", START), ("N", "new", START)], "id string, raw_message string, arrival timestamp")
    finished = spark.createDataFrame(
        [("A", START, None, None, "timeout"), ("E", START, ("otro", "baja", "data", "es", "x", False, None, 0.5, "E", "v1"), None, None)],
        f"id string, at timestamp, classification {schemas.CLASSIFICATION.simpleString()}, metadata {schemas.METADATA.simpleString()}, error_type string",
    )
    rows = {row.id: row for row in upsert_requests(stored, reserved, finished).collect()}
    assert {i: row.state for i, row in rows.items()} == {"A": "completed", "E": "completed", "N": "processing"}
    assert rows["A"].raw_message == "text A" and rows["A"].failure_code is None
    assert rows["E"].effective_category == "otro" and rows["E"].classified_at == START
