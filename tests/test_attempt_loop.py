"""Rounds of attempts against a message-by-message loop."""

import json
import random
import re
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sluice import fixed_values as V
from sluice import schemas
from sluice.operators import accounting, attempt_loop
from sluice.operators.accounting import account_usage
from sluice.operators.attempt_loop import classify_rounds
from sluice.sources.store import guard_finished, upsert_requests

GOOD = {
    "categoria": "bug", "prioridad": "alta", "area_sugerida": "data", "idioma": "es", "resumen": "Pago con error", "requiere_info": False,
    "pregunta_seguimiento": None, "confianza": 0.5,
}
RESULT = "id string, answer string, error_type string, model string, input_tokens long, output_tokens long, cached_input_tokens long, latency_ms double"
#: What each call of a message brings.
KINDS = ["good", "broken", "english", "urgent", "timeout", "refusal", "authentication", "odd_kind", "silent", "twice"]


def _script(seed, count):
    rng = random.Random(seed)
    return {f"m{n}": [rng.choice(KINDS) for _ in range(4)] for n in range(count)}


def _row(message_id, attempt, kind):
    answer, error = None, None
    if kind == "good":
        answer = json.dumps(GOOD)
    elif kind == "broken":
        answer = '{"categoria": "bug"'
    elif kind == "english":
        answer = json.dumps(GOOD | {"resumen": "english words"})
    elif kind == "urgent":
        answer = json.dumps(GOOD | {"prioridad": "urgente"})
    else:
        error = kind
    used = (None, None, None) if error else (100 * attempt, 10, 5 if attempt > 1 else None)
    return (message_id, answer, error, "model-a", *used, 1.5)


def _caller(script, counter):
    def call(rows):
        def answer(batches):
            for batch in batches:
                out = []
                for message_id, attempt in zip(batch["id"], batch["attempt"]):
                    counter.add(1)
                    kind = script[message_id][attempt - 1]
                    if kind != "silent":
                        out += [_row(message_id, attempt, kind)] * (2 if kind == "twice" else 1)
                yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])

        return rows.mapInPandas(answer, RESULT)

    return call


def _policy(summaries):
    return summaries.select("id", (~F.col("resumen").startswith("english")).alias("summary_accepted"))


def _expected(script, budget):
    retryable = {k for k, again, _ in V.ERROR_KINDS if again}
    meaning = {"good": None, "broken": "invalid_classification", "urgent": "invalid_classification", "english": "invalid_summary_language", "silent": "unexpected_error", "twice": "unexpected_error"}
    outcomes, calls = {}, []
    for message_id, kinds in script.items():
        for attempt, kind in enumerate(kinds[:budget], 1):
            reason = meaning.get(kind, kind)
            calls.append((message_id, attempt, reason))
            if reason is None or reason not in retryable or attempt == budget:
                outcomes[message_id] = (reason, attempt)
                break
    return outcomes, calls


@pytest.mark.parametrize("budget", [1, 3])
def test_rounds_equal_a_loop(spark, budget):
    script = _script(5, 150)
    counter = spark.sparkContext.accumulator(0)
    messages = spark.createDataFrame([(i, "texto", 1) for i in script], "id string, message string, state int").repartition(3)
    pricing = spark.createDataFrame([("model-a", Decimal("1"), Decimal("2"), Decimal("0.5"))], "model string, input_per_million decimal(12,6), output_per_million decimal(12,6), cached_input_per_million decimal(12,6)")
    found = classify_rounds(messages, _caller(script, counter), _policy, pricing, prompt_version="v3", max_attempts=budget)
    outcomes, calls = _expected(script, budget)
    assert counter.value == len(calls)  # nothing is called that is settled, and nothing twice
    assert {r.id: (r.failure_category, r.attempts) for r in found.outcomes.collect()} == outcomes
    assert sorted((r.id, r.attempt, r.error_type) for r in found.attempts.collect()) == sorted(calls, key=lambda c: c[:2])
    assert counter.value == len(calls)  # using the result calls nothing again
    for row in found.outcomes.collect():
        good = row.failure_category is None
        assert (row.state == "succeeded") == good == (row.classification is not None) == (row.metadata is not None)
        if good:
            m = row.metadata
            assert (m.model, m.attempt, m.prompt_version, row.classification.id, row.classification.version_prompt) == ("model-a", row.attempts, "v3", row.id, "v3")
            cached = m.cached_input_tokens or 0
            assert m.estimated_cost_usd == (Decimal(m.input_tokens - cached) + 2 * m.output_tokens + Decimal("0.5") * cached) / 1_000_000


def test_result_can_be_stored_and_accounted(spark):
    script = {"a": ["timeout", "good"], "b": ["refusal"], "c": ["english", "english", "good"], "d": ["timeout", "timeout", "timeout"], "e": ["good"]}
    counter = spark.sparkContext.accumulator(0)
    messages = spark.createDataFrame([(i, "texto") for i in script], "id string, message string")
    found = classify_rounds(messages, _caller(script, counter), _policy)
    at = F.lit("2024-01-01").cast("timestamp")
    good, bad = guard_finished(found.finished(at))
    assert bad.count() == 0
    reserved = spark.createDataFrame([(i, "texto") for i in script], "id string, raw_message string").withColumn("arrival", at)
    stored = upsert_requests(spark.createDataFrame([], schemas.REQUEST), reserved, good)
    assert {r.id: (r.state, r.failure_code, r.effective_category) for r in stored.collect()} == {
        "a": ("completed", None, "bug"), "b": ("failed", "refusal", None), "c": ("completed", None, "bug"), "d": ("failed", "timeout", None), "e": ("completed", None, "bug"),
    }
    summary, reasons = account_usage(found.events(F.lit("run-1")), found.run_items(F.lit("run-1"), "v1", 3))
    row = summary.first()
    assert (row.observed_model_calls, row.input_tokens_known_subtotal) == (10, 200 + (100 + 200 + 300) + 100)
    assert {(r.message_id, r.reason) for r in reasons.collect()} == {("b", "failed_attempt_count_unknown"), ("d", "failed_attempt_count_unknown")}


def test_structured_answers_and_odd_messages(spark):
    kind = schemas.ANSWER.simpleString()

    def caller(rows):
        fields = ", ".join(f"{'null' if v is None else repr(v).lower() if isinstance(v, bool) else repr(v)} AS {k}" for k, v in GOOD.items())
        return rows.selectExpr(
            "id", f"CASE WHEN id <> 'none' THEN CAST(struct({fields}) AS {kind}) END AS structured", "CAST(null AS string) AS error_type", "CAST(null AS string) AS model",
            "CAST(null AS long) AS input_tokens", "CAST(null AS long) AS output_tokens", "CAST(null AS long) AS cached_input_tokens", "2.0D AS latency_ms",
        )

    messages = spark.createDataFrame([("x", "hola"), ("y", None), ("z", ""), ("none", "q"), (" ", "blank"), (None, "null")], "id string, message string")
    found = classify_rounds(messages, caller, model="m9", max_attempts=2)
    rows = {r.id: r for r in found.outcomes.collect()}
    assert {i: (r.state, r.failure_category, r.attempts) for i, r in rows.items()} == {
        "x": ("succeeded", None, 1), "y": ("succeeded", None, 1), "z": ("succeeded", None, 1), "none": ("failed", "invalid_classification", 2),
        " ": ("failed", "unexpected_error", 0), None: ("failed", "unexpected_error", 0),
    }
    assert rows["x"].metadata.model == "m9" and rows["x"].metadata.estimated_cost_usd is None and rows["x"].classification.prioridad == "alta"
    assert classify_rounds(messages.limit(0), caller).outcomes.count() == 0
    with pytest.raises(ValueError):
        classify_rounds(messages, caller, max_attempts=0)


def test_policy_reads_answers_that_are_written_down(spark):
    """What stands behind an answer, joins and all, is not done again for the policy."""
    plans = []

    def policy(rows):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return rows.select("id", (F.col("resumen") == GOOD["resumen"]).alias("summary_accepted"))

    script = {"a": ["good"] * 2, "b": ["english", "good"], "c": ["silent", "twice"]}
    messages = spark.createDataFrame([(key, "hola") for key in script], "id string, message string")
    found = classify_rounds(messages, _caller(script, spark.sparkContext.accumulator(0)), policy, max_attempts=2)
    assert {r.id: (r.state, r.failure_category, r.attempts) for r in found.outcomes.collect()} == {
        "a": ("succeeded", None, 1), "b": ("succeeded", None, 2), "c": ("failed", "unexpected_error", 1)}
    assert len(plans) == 2 and not any("Join" in plan for plan in plans)


def test_ids_are_never_gathered_on_the_driver(spark, monkeypatch):
    """Joins by ID are the same at every size: sizes of files say little about the rows in them."""
    plans = []

    def plan(rows):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return rows

    for module in (attempt_loop, accounting):
        monkeypatch.setattr(module, "settle", lambda rows, whole=module.settle: whole(plan(rows)))
    script = {"a": ["timeout", "good"], "b": ["refusal"], "c": ["english", "good"]}
    messages = spark.createDataFrame([(i, "texto") for i in script], "id string, message string")
    found = classify_rounds(messages, _caller(script, spark.sparkContext.accumulator(0)), _policy, max_attempts=2)
    summary, reasons = account_usage(found.events(F.lit("run-1")), found.run_items(F.lit("run-1"), "v1", 2))
    assert plan(summary).first().observed_model_calls == 5 and {(r.message_id, r.reason) for r in plan(reasons).collect()} == {("b", "failed_attempt_count_unknown")}
    by_id = [line for p in plans for line in p.split("\n") if "Join" in line and re.search(r"\b(message_)?id#", line)]
    assert len(by_id) >= 8 and all("SortMergeJoin" in line for line in by_id), by_id
