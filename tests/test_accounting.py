import json

import pytest
from pyspark.sql import functions as F

from sluice.operators.accounting import account_usage
from sluice.operators.attempts import resolve_attempts
from sluice.sources.attempt_log import append_attempt_log, read_attempt_log, read_lines

OUTCOME = (
    "run_id string, id string, state string, prompt_version string, max_attempts int, meta_model string, meta_attempt int,"
    " meta_input_tokens long, meta_output_tokens long, meta_cached_input_tokens long, meta_estimated_cost_usd string"
)


def _event(attempt, message="m1", success=False, **changes):
    return {
        "event": "model_call", "message_id": message, "attempt": attempt, "model": "mod", "prompt_version": "v1", "success": success,
        "input_tokens": 10, "output_tokens": 2, "cached_input_tokens": None, "estimated_cost_usd": 0.01, **changes,
    }


def _outcome(state="succeeded", attempt=2, **changes):
    return {
        "run_id": "r1", "id": "m1", "state": state, "prompt_version": "v1", "max_attempts": 3, "meta_model": "mod", "meta_attempt": attempt,
        "meta_input_tokens": 10, "meta_output_tokens": 2, "meta_cached_input_tokens": None, "meta_estimated_cost_usd": "0.010", **changes,
    }


GOOD = [_event(1), _event(2, success=True)]
CASES = {
    "complete": (GOOD, [_outcome()], {}, (2, 20), (True, True)),
    "first lost": (GOOD[1:], [_outcome()], {"incomplete_attempt_sequence": 1}, (1, 10), (False, False)),
    "repeated": ([GOOD[0], *GOOD], [_outcome()], {"duplicate_attempt": 1}, (3, 20), (False, False)),
    "foreign": ([*GOOD, _event(1, "m9")], [_outcome()], {"foreign_message_event": 1}, (3, 20), (False, False)),
    "foreign id of another type": ([*GOOD, _event(1, 7)], [_outcome()], {"foreign_message_event": 1}, (3, 20), (False, False)),
    "final too small": (GOOD, [_outcome(attempt=1)], {"incomplete_attempt_sequence": 1}, (2, 20), (False, False)),
    "over budget": ([*GOOD], [_outcome(max_attempts=1)], {"incomplete_attempt_sequence": 1}, (2, 20), (False, False)),
    "other tokens": (GOOD, [_outcome(meta_input_tokens=11)], {"inconsistent_success_metadata": 1}, (2, 20), (False, False)),
    "other cost": (GOOD, [_outcome(meta_estimated_cost_usd=None)], {"inconsistent_success_metadata": 1}, (2, 20), (False, False)),
    "early success": ([_event(1, success=True), GOOD[1]], [_outcome()], {"inconsistent_attempt_result": 1}, (2, 20), (False, False)),
    "early unknown": ([_event(1, success=None), GOOD[1]], [_outcome()], {"inconsistent_attempt_result": 1}, (2, 20), (False, False)),
    "final failed": ([GOOD[0], _event(2)], [_outcome()], {"inconsistent_success_metadata": 1}, (2, 20), (False, False)),
    "other prompt": ([_event(1, prompt_version="v0"), GOOD[1]], [_outcome()], {"inconsistent_attempt_provenance": 1}, (2, 20), (False, False)),
    "bad numbers": ([_event(0), _event(True), _event("1"), _event(1.5), *GOOD], [_outcome()], {"invalid_attempt": 4}, (6, 20), (False, False)),
    "failed": (GOOD, [_outcome("failed")], {"failed_attempt_count_unknown": 1}, (2, 20), (False, False)),
    "failed unseen": ([], [_outcome("failed")], {"missing_attempt": 1}, (0, 0), (False, False)),
    "succeeded unseen": ([], [_outcome()], {"missing_attempt": 1}, (0, 0), (False, False)),
    "pending seen": (GOOD, [_outcome("pending")], {"pending_has_attempts": 1}, (2, 20), (False, False)),
    "pending": ([], [_outcome("pending")], {}, (0, 0), (True, True)),
    "running": (GOOD, [_outcome("running")], {"unknown_outcome": 1}, (2, 20), (False, False)),
    "interrupted": ([], [_outcome("interrupted_unknown")], {"unknown_outcome": 1}, (0, 0), (False, False)),
    "unknown usage": ([_event(1, input_tokens=None), GOOD[1]], [_outcome()], {}, (2, 10), (False, True)),
    "unknown cost": ([_event(1, estimated_cost_usd=None), GOOD[1]], [_outcome()], {}, (2, 20), (True, False)),
    "no newline": ([*GOOD, '{"event": "model_call", "message'], [_outcome()], {"truncated_final_event": 1}, (2, 20), (False, False)),
    "no newline but whole": ([GOOD[0], json.dumps(GOOD[1])], [_outcome()], {}, (2, 20), (True, True)),
    "bad lines": (["x", "[1]", '"s"', json.dumps({"event": "e"}), "", *GOOD], [_outcome()], {"invalid_event": 5}, (2, 20), (False, False)),
    "unfinished list at the end": ([*GOOD, "[1]"], [_outcome()], {"invalid_event": 1}, (2, 20), (False, False)),
}


def test_accounting_cases(spark, tmp_path):
    """Every case is a run of its own: all logs are read and accounted together."""
    outcomes = []
    for number, (name, (lines, items, *_)) in enumerate(CASES.items()):
        folder = tmp_path / f"run_id=r{number}"
        folder.mkdir()
        texts = [line if isinstance(line, str) else json.dumps(line) for line in lines]
        whole = bool(texts) and not name.startswith(("no newline", "unfinished"))
        (folder / "calls.jsonl").write_text("\n".join(texts) + ("\n" if whole else ""), encoding="utf-8")
        outcomes += [{**item, "run_id": f"r{number}"} for item in items]
    names = [part.split()[0] for part in OUTCOME.split(", ")]
    table = spark.createDataFrame([tuple(item[name] for name in names) for item in outcomes], OUTCOME)
    events, bad = read_attempt_log(spark, str(tmp_path))
    summary, reasons = account_usage(events, table, bad)
    found_reasons = {}
    for row in reasons.collect():
        found_reasons.setdefault(row.run_id, {})[row.reason] = row.occurrences
    found = {row.run_id: row for row in summary.collect()}
    for number, (name, (_, _, expected, sums, complete)) in enumerate(CASES.items()):
        row = found[f"r{number}"]
        assert found_reasons.get(f"r{number}", {}) == expected, name
        assert (row.observed_model_calls, row.input_tokens_known_subtotal) == sums, name
        assert (row.usage_complete, row.cost_complete) == complete, name


def test_first_attempt_in_the_file_counts_across_splits(spark, tmp_path):
    folder = tmp_path / "run_id=r1"
    folder.mkdir()
    events = [_event(1, input_tokens=n, padding="x" * 200) for n in range(2000)] + [_event(2, success=True)]
    (folder / "calls.jsonl").write_text("".join(json.dumps(event) + "\n" for event in events), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        good, bad = read_attempt_log(spark, str(tmp_path))
        assert read_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 10
        outcomes = spark.createDataFrame([tuple(_outcome().values())], OUTCOME)
        summary, reasons = account_usage(good, outcomes, bad)
        row = summary.first()
        assert (row.observed_model_calls, row.input_tokens_known_subtotal) == (2001, 0 + 10)
        assert [(r.reason, r.occurrences) for r in reasons.collect()] == [("duplicate_attempt", 1999)]
        assert bad.count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_appended_log_reads_back_without_message_text(spark, tmp_path):
    rows = [("r1", "m1", "mod", "v1", 1, 12.34567, 5, 1, 0, 0.5, False, "timeout", "secret"), ("r1", "m1", "mod", "v1", 2, 1.0, None, None, None, None, True, None, "secret")]
    table = spark.createDataFrame(rows, "run_id string, message_id string, model string, prompt_version string, attempt int, latency_ms double, input_tokens long, output_tokens long, cached_input_tokens long, estimated_cost_usd double, success boolean, error_type string, message string")
    append_attempt_log(table, str(tmp_path / "log"))
    append_attempt_log(table.where("success"), str(tmp_path / "log"))
    events, bad = read_attempt_log(spark, str(tmp_path / "log"))
    assert bad.count() == 0 and events.count() == 3
    text = spark.read.text(str(tmp_path / "log"))
    assert text.where(F.col("value").contains("secret")).count() == 0
    assert text.where(F.col("value").contains("error_type")).count() == 1
    assert {row.latency_ms for row in events.collect()} == {12.346, 1.0}
    assert text.where(F.col("value").contains('"input_tokens":null')).count() == 2


@pytest.mark.parametrize("attempts,expected", [
    ([(1, False, "timeout"), (2, True, None)], ("succeeded", 2, None)),
    ([(1, False, "refusal"), (2, True, None)], ("failed", 1, "refusal")),
    ([(1, False, "timeout"), (2, False, "rate_limit"), (3, False, "invalid_classification")], ("failed", 3, "invalid_classification")),
    ([(1, False, "timeout"), (2, False, "timeout"), (3, False, "timeout"), (4, True, None)], ("failed", 3, "timeout")),
    ([(1, False, "invalid_summary_language"), (2, False, "server_error"), (3, True, None)], ("succeeded", 3, None)),
])
def test_attempt_budget(spark, attempts, expected):
    rows = spark.createDataFrame([("k", n, n, ok, kind) for n, ok, kind in attempts], "id string, attempt int, line int, success boolean, error_type string")
    row = resolve_attempts(rows).first()
    assert (row.state, row.attempt, row.failure_category) == expected
