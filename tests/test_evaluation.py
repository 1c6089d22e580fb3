import random
import statistics

import pytest
from pyspark.sql import functions as F

from sluice import fixed_values as V
from sluice.operators import comparison as X
from sluice.operators import evaluation as E
from sluice.operators import guards as G

IDS = [f"k-{n:02d}" for n in range(1, 13)]
TRUTH = {"categoria": "bug", "prioridad": "media", "area_sugerida": "data", "idioma": "es", "requiere_info": True}
WRONG = {"categoria": "otro", "prioridad": "alta", "area_sugerida": "devops", "idioma": "pt", "requiere_info": False}
# Fields that are wrong per item number, in two runs: 47 of 60 right both times, 6 corrected, 6 new.
FIRST = {"categoria": {1, 2}, "prioridad": {1, 2, 3, 4}, "area_sugerida": {5, 6, 7}, "requiere_info": {3, 4, 8, 9}}
SECOND = {"categoria": {2}, "prioridad": {2, 3, 4, 10, 5, 6}, "area_sugerida": {7, 1}, "requiere_info": {3, 4, 7, 10}}
COLUMNS = "id string, state string, failure_category string, categoria string, prioridad string, area_sugerida string, idioma string, requiere_info boolean, confianza double"


def _references(spark):
    rows = [(i, *[TRUTH[name] for name in V.SCORED_FIELDS]) for i in IDS]
    return spark.createDataFrame(rows, "id string, " + ", ".join(f"ref_{n} {'boolean' if n == 'requiere_info' else 'string'}" for n in V.SCORED_FIELDS))


def _run(spark, wrong, broken=()):
    rows = []
    for n, i in enumerate(IDS, 1):
        if i in dict(broken):
            state, category = dict(broken)[i]
            if state is not None:
                rows.append((i, state, category, None, None, None, None, None, None))
            continue
        values = [(WRONG if n in wrong.get(name, ()) else TRUTH)[name] for name in V.SCORED_FIELDS]
        rows.append((i, "succeeded", None, *values, n / 100))
    return spark.createDataFrame(rows, COLUMNS)


def test_totals_and_comparison_of_two_runs(spark):
    references, first, second = _references(spark), _run(spark, FIRST), _run(spark, SECOND)
    report = E.score(references, first)
    assert {row.field: row.correct for row in report["fields"].collect()} == {
        "categoria": 10, "prioridad": 8, "area_sugerida": 9, "idioma": 12, "requiere_info": 8,
    }
    overall = report["overall_exact_fields"].first()
    assert (overall.correct, overall.total, round(overall.accuracy, 4)) == (47, 60, 0.7833)
    assert report["all_five_fields"].first().correct == 3
    assert [row.id for row in report["exact_message_ids"].collect()] == ["k-10", "k-11", "k-12"]
    result = X.compare(references, first, second)
    assert {row.field: row.delta for row in result["field_delta"].collect()} == {
        "categoria": 1, "prioridad": -2, "area_sugerida": 1, "idioma": 0, "requiere_info": 0, "overall": 0,
    }
    corrected = [(row.id, row.field) for row in result["corrected"].collect()]
    assert len(corrected) == 6 and corrected == sorted(corrected)
    assert result["regressions"].count() == 6


def test_failures_and_omissions_stay_in_the_denominator(spark):
    broken = [("k-11", ("failed", None)), ("k-12", (None, None)), ("k-10", ("failed", "timeout")), ("k-09", ("pending", None))]
    report = E.score(_references(spark), _run(spark, FIRST, broken))
    assert {row.total for row in report["fields"].collect()} == {12}
    assert report["overall_exact_fields"].first().total == 60
    assert {row.state: row.failures for row in report["failure_counts"].collect()} == {"failed": 2, "missing": 1, "pending": 1}
    assert {row.category: row.failures for row in report["failure_category_counts"].collect()} == {"execution_error": 1, "timeout": 1}
    stats = {row.group: row for row in report["confidence"].collect()}
    assert (stats["exact"]["count"], stats["exact"]["mean"], stats["exact"]["median"]) == (0, None, None)
    assert stats["disagreement"]["count"] == 8 and stats["disagreement"]["median"] == pytest.approx(0.045)
    assert [row.id for row in report["highest_confidence_mistakes"].collect()][0] == "k-08"
    assert [row.id for row in report["lowest_successful"].collect()][:2] == ["k-01", "k-02"]


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_median_is_exact(spark, size):
    dice = random.Random(size)
    values = [(dice.choice("ab"), dice.choice([0.0, 1.0, 0.5, dice.random(), dice.random() / 1e6])) for _ in range(size)]
    counted = spark.createDataFrame(values, "g string, v double").groupBy("g", "v").agg(F.count("*").alias("n"))
    found = {row.g: row.median for row in E.grouped_median(counted, "g", "v", "n").collect()}
    for group in found:
        assert found[group] == pytest.approx(statistics.median(v for g, v in values if g == group), abs=0)
    assert set(found) == {g for g, _ in values}


def test_coverage(spark):
    expected = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("d", 3), ("e", 4)], "id string, position int")
    found = [("a", 0, "x"), ("b", 2, "x"), ("c", 1, " "), ("d", 3, "x"), ("d", 4, "x"), ("z", 5, "x")]
    found = spark.createDataFrame(found, "id string, position int, text string")
    assert {row.id: row.status for row in E.check_coverage(expected, found, ["text"]).collect()} == {
        "a": "ok", "b": "out_of_order", "c": "empty_text", "d": "duplicate", "e": "missing", "z": "unexpected",
    }


@pytest.mark.parametrize("hot_rows", [2, 1_000_000])
def test_nothing_starts_after_a_fatal_failure(spark, hot_rows):
    rows = [("r", n, {5: "authentication", 2: "timeout", 8: "configuration"}.get(n)) for n in range(10)] + [("s", n, "timeout") for n in range(3)]
    items = spark.createDataFrame(rows, "run_id string, position int, error_type string")
    found = G.fatal_cutoff(items, ["position"], hot_rows).collect()
    assert sorted(row.position for row in found if row.run_id == "r" and row.started) == [0, 1, 2, 3, 4, 5]
    assert all(row.started for row in found if row.run_id == "s") and len(found) == 13


def test_fingerprint_notices_order_and_content(spark):
    def digest(rows):
        table = spark.createDataFrame(
            [("r", n, i, "succeeded", i, "v1", "v1") for n, i in enumerate(rows)],
            "run_id string, position int, id string, state string, classification_id string, metadata_version string, prompt_version string",
        )
        return G.outcome_digest(table).first().item_fingerprint

    assert digest(["a", "b", "c"]) == digest(["a", "b", "c"])
    assert len({digest(["a", "b", "c"]), digest(["b", "a", "c"]), digest(["a", "b"])}) == 3


def test_comparability_with_one_popular_baseline(spark):
    runs = [(f"r{n}", f"v{n % 2 + 1}", f"p{n % 2}", "m", "f", "x", n != 4, True, 1, "model") for n in range(8)]
    runs = spark.createDataFrame(runs, "run_id string, prompt_version string, prompt_sha256 string, messages_sha256 string, references_sha256 string, execution string, complete boolean, provenance_ok boolean, models int, model string")
    pairs = spark.createDataFrame([("r0", f"r{n}") for n in range(1, 8)] + [("r0", "r99"), ("r1", "r4")], "baseline string, candidate string")
    for hot_rows in (2, 1_000_000):
        found = {(row.baseline, row.candidate): row.reasons for row in G.comparability(pairs, runs, hot_rows).collect()}
        assert found["r0", "r1"] == [] and found["r0", "r2"] == ["same_prompt_version", "same_prompt_text"]
        assert found["r1", "r4"] == ["incomplete"] and found["r0", "r99"] == ["unknown_run"] and len(found) == 9


def test_repeated_and_unexpected_outcomes_are_refused(spark):
    references = spark.createDataFrame([("a", "bug"), ("b", "bug"), ("c", "bug")], "id string, ref_categoria string")
    outcomes = spark.createDataFrame([("a", "succeeded"), ("b", "succeeded"), ("b", "succeeded"), ("b", "failed"), ("z", "succeeded")], "id string, state string")
    for name in V.SCORED_FIELDS:
        kind = "boolean" if name == "requiere_info" else "string"
        value = F.lit("bug") if name == "categoria" else F.lit(None).cast(kind)
        outcomes = outcomes.withColumn(name, value)
        if name != "categoria":
            references = references.withColumn(f"ref_{name}", F.lit(None).cast(kind))
    outcomes = outcomes.withColumn("failure_category", F.lit(None).cast("string")).withColumn("confianza", F.lit(0.5))
    parts = E.score(references, outcomes)
    assert {(r.field, r.correct, r.total) for r in parts["fields"].collect()} == {(f, 1, 3) for f in V.SCORED_FIELDS}
    assert {(r.id, r.state) for r in parts["failures"].collect()} == {("b", "repeated"), ("c", "missing")}
    assert {(r.id, r.reason, r.rows) for r in parts["refused"].collect()} == {("b", "repeated", 3), ("z", "unexpected", 1)}
    plan = parts["mismatches"]._jdf.queryExecution().toString()
    assert "Join" not in plan  # the sections read one settled join


def test_median_of_values_that_lie_close_together(spark):
    """Ten thousand values in one part of a million million, and a group of one value; windows of at most 16 rows."""
    rows = [("near", 0.5 + k * 1e-15, 1 + k % 3) for k in range(0, 20_000, 2)] + [("one", 0.25, 7)] + [("two", 0.1, 1), ("two", 0.9, 1)] + [("far", k / 999, 1) for k in range(1000)]
    merged = {}
    for group, value, n in rows:
        merged[group, value] = merged.get((group, value), 0) + n
    table = spark.createDataFrame([(g, v, n) for (g, v), n in merged.items()], "g string, v double, n long")
    found = {r.g: r.median for r in E.grouped_median(table, "g", "v", "n", buckets=16, few=8).collect()}
    for group in ("near", "one", "two", "far"):
        values = sorted(v for (g, v), n in merged.items() if g == group for _ in range(n))
        middle = (values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2
        assert found[group] == middle, group
    assert E.grouped_median(table.limit(0), "g", "v", "n").count() == 0
