import json
import os
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sluice.operators.requests import effective_classification
from sluice.streaming.corrections import requests_table, resume_corrections, stream_corrections
from sluice.streaming.intake import FIRSTS, decide_intake, request_states, stage_intake, stream_intake
from sluice.streaming.usage import latest_usage, stream_usage, tail_lines
from tests.test_corrections import BASE, START, _request, _table
from sluice import schemas


def _arrive(folder, name, rows):
    folder.mkdir(exist_ok=True)
    path = folder / name
    path.write_text("".join(json.dumps(row) + "\n" for row in rows), encoding="utf-8")
    # File streams go by modification time: files of one instant get their names' order.
    os.utime(path, (1_700_000_000 + int(name[0]), 1_700_000_000 + int(name[0])))


INTAKE = "id string, raw_message string, arrival long, target string, failure_code string"


def _intake(spark, source, base, per_batch=1, hot_rows=1):
    stream = spark.readStream.schema(INTAKE).option("maxFilesPerTrigger", per_batch).json(str(source))
    query = stream_intake(stream, str(base), ["arrival"], hot_rows=hot_rows)
    query.awaitTermination()
    return query


def _outcomes(spark, base):
    return {row.arrival: row.outcome for row in spark.read.schema(INTAKE + ", outcome string").parquet(f"{base}/outcomes").collect()}


def test_intake_keeps_reservations_over_batches_and_restarts(spark, tmp_path):
    source, base = tmp_path / "in", tmp_path / "base"
    row = lambda i, text, at: {"id": i, "raw_message": text, "arrival": at}
    end = lambda i, target, at: {"id": i, "target": target, "arrival": at, "failure_code": "timeout" if target == "failed" else None}
    _arrive(source, "1.json", [row("a", "x", 2), row("a", "y", 1), row("b", "q", 3), row("b", "q", 8), row(None, "x", 20), row(" ", "x", 21), row("d", " ", 22)])
    _intake(spark, source, base)
    assert _outcomes(spark, base) == {1: "created", 2: "conflict", 3: "created", 8: "duplicate", 20: "invalid", 21: "invalid", 22: "invalid"}
    _arrive(source, "2.json", [row("a", "y", 0), row("b", "other", 4), row("c", "z", 5), end("a", "completed", 40), end("a", "failed", 41), end("nobody", "failed", 42)])
    _arrive(source, "3.json", [row("c", "z", 6), row("c", "Z", 7), row("a", "y", 9), row("d", "real", 23), end("b", "failed", 43), end("b", "completed", 44), end("c", "completed", 45)])
    _arrive(source, "4.json", [row("b", "q", 10), row("c", "z", 11), row("d", "real", 24), end("a", "failed", 46), row("nobody", "n", 12)])
    _intake(spark, source, base)
    found = _outcomes(spark, base)
    assert {at: found[at] for at in (0, 4, 5, 40, 41, 42)} == {0: "in_progress", 4: "conflict", 5: "created", 40: "applied", 41: "not_processing", 42: "not_found"}
    assert {at: found[at] for at in (6, 7, 9, 23, 43, 44, 45)} == {6: "in_progress", 7: "conflict", 9: "duplicate_completed", 23: "created", 43: "applied", 44: "not_processing", 45: "applied"}
    assert {at: found[at] for at in (10, 11, 24, 46, 12)} == {10: "failed_terminal", 11: "duplicate_completed", 24: "in_progress", 46: "not_processing", 12: "created"}
    states = {row.id: (row.state, row.failure_code) for row in request_states(spark, str(base)).collect()}
    assert states == {"a": ("completed", None), "b": ("failed", "timeout"), "c": ("completed", None), "d": ("processing", None), "nobody": ("processing", None)}
    _intake(spark, source, base)
    assert _outcomes(spark, base) == found


def test_intake_of_several_staged_batches_in_one_step(spark, tmp_path):
    """The decider may lag: batches staged meanwhile are decided in their order."""
    source, base = tmp_path / "in", tmp_path / "base"
    for n in range(1, 5):
        _arrive(source, f"{n}.json", [{"id": "a", "raw_message": "t", "arrival": n}] + ([{"id": "a", "target": "completed", "arrival": 90 + n}] if n == 2 else []))
    stream = spark.readStream.schema(INTAKE).option("maxFilesPerTrigger", 1).json(str(source))
    stage_intake(stream, str(base), ["arrival"]).awaitTermination()
    decide_intake(spark, str(base), ["arrival"]).awaitTermination()
    assert _outcomes(spark, base) == {1: "created", 2: "in_progress", 92: "applied", 3: "duplicate_completed", 4: "duplicate_completed"}
    # A staged batch that is written again, as after a lost driver, changes nothing.
    again = spark.read.parquet(f"{base}/firsts/batch=3").collect()
    spark.createDataFrame(again, FIRSTS.rsplit(", batch", 1)[0]).write.mode("overwrite").parquet(f"{base}/firsts/batch=3")
    decide_intake(spark, str(base), ["arrival"]).awaitTermination()
    assert _outcomes(spark, base)[4] == "duplicate_completed" and spark.read.parquet(f"{base}/decided").count() == 4


def test_intake_state_work_follows_the_batch_not_the_history(spark, tmp_path):
    source, base = tmp_path / "in", tmp_path / "base"
    updated, read = [], []
    for n in range(1, 7):
        fresh = [{"id": f"{n}-{k}", "raw_message": "t" * 50, "arrival": n} for k in range(400 if n < 6 else 20)]
        _arrive(source, f"{n}.json", fresh + [{"id": "1-1", "raw_message": "t" * 50, "arrival": n}])
        query = _intake(spark, source, base)
        work = [p["stateOperators"][0] for p in query.recentProgress if p["numInputRows"]]
        updated.append(sum(w["numRowsUpdated"] for w in work))
        read.append(sum(w["customMetrics"].get("rocksdbTotalBytesRead", 0) for w in work))
        total = work[-1]["numRowsTotal"]
    assert total == 5 * 400 + 20
    assert updated[-1] <= 2 * 21 and updated[1] >= 400  # keys of the batch, whatever was reserved before
    assert max(read[1:]) <= 2 * read[1]  # state bytes read for a batch do not grow with the history


def test_intake_is_decided_by_native_state_as_one_by_one(spark, tmp_path):
    """No Python call for each ID; several staged batches in one step, events before an ID is reserved, more batches later."""
    source, base, rng = tmp_path / "in", tmp_path / "base", random.Random(3)
    kept, expected, at = {}, {}, 0
    for n in range(1, 6):
        rows = []
        for _ in range(30):
            at += 1
            event = rng.random() < 0.4
            rows.append({"id": f"i{rng.randrange(30)}", "arrival": at} | ({"target": rng.choice(["completed", "failed"])} if event else {"raw_message": rng.choice(["x", "y"])}))
        before = {key: state for key, (_, state) in kept.items()}
        for row in [r for r in rows if "target" not in r]:
            first = row["id"] not in kept
            owner = kept.setdefault(row["id"], (row["raw_message"], "processing"))[0]
            known = {"processing": "in_progress", "completed": "duplicate_completed", "failed": "failed_terminal"}.get(before.get(row["id"]))
            expected[row["arrival"]] = "conflict" if row["raw_message"] != owner else known or ("created" if first else "duplicate")
        for row in [r for r in rows if "target" in r]:
            owner, state = kept.get(row["id"], (None, None))
            expected[row["arrival"]] = "not_found" if state is None else "applied" if state == "processing" else "not_processing"
            if state == "processing":
                kept[row["id"]] = (owner, row["target"])
        _arrive(source, f"{n}.json", rows)
        if n in (4, 5):
            query = _intake(spark, source, base)
            assert _outcomes(spark, base) == expected
            assert {o["operatorName"] for p in query.recentProgress for o in p["stateOperators"]} == {"stateStoreSave"}
    assert {r.id: r.state for r in request_states(spark, str(base)).collect()} == {key: state for key, (_, state) in kept.items()}
    assert set(expected.values()) >= {"created", "conflict", "applied", "not_found", "not_processing", "in_progress", "failed_terminal"}


def test_corrections_over_batches_equal_arrival_order(spark, tmp_path):
    changes = [
        {"categoria": "datos"}, {"requiere_info": True}, {"requiere_info": True, "pregunta_seguimiento": "¿Qué?"},
        {"pregunta_seguimiento": "¿Cuál?"}, {"pregunta_seguimiento": None}, {"prioridad": "nada"},
        {"requiere_info": False, "pregunta_seguimiento": None}, {"requiere_info": False, "prioridad": "baja"},
    ]
    requests = spark.createDataFrame([_request("r", "completed", BASE), _request("p", "processing", BASE)], schemas.REQUEST)
    source = str(tmp_path / "in")
    rows = [("r", START + timedelta(minutes=n), n, change) for n, change in enumerate(changes)]
    schema = _table(spark, rows).schema

    def stream():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)

    paths = [str(tmp_path / name) for name in ("table", "rejected", "checkpoint")]
    for part in (rows[:3], rows[3:5]):
        _table(spark, part).coalesce(1).write.mode("append").parquet(source)
    stream_corrections(stream(), requests, *paths).awaitTermination()
    _table(spark, rows[5:]).coalesce(1).write.mode("append").parquet(source)
    resume_corrections(stream(), *paths).awaitTermination()
    rejected = spark.read.parquet(paths[1]).collect()
    assert {row.seq for row in rejected} == {1, 4, 5}
    table = requests_table(spark, paths[0])
    final = table.read().where("id = 'r'").select(effective_classification().alias("e")).first().e
    assert (final.categoria, final.prioridad, final.requiere_info, final.pregunta_seguimiento) == ("datos", "baja", False, None)
    assert [table.rewritten(v) for v in (1, 3, 5)] == [1, 1, 1]  # the bucket of one request, of two requests in 64 buckets
    assert table.read(0).count() == table.read().count() == 2 and table.read(0).where("human_correction IS NOT NULL").count() == 0


def test_running_usage_grows_with_the_log(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    event = lambda n: {"event": "model_call", "message_id": "m", "attempt": n, "input_tokens": 10, "output_tokens": None, "estimated_cost_usd": 0.5}
    _arrive(log / "run_id=a", "1.jsonl", [event(1), event(2), "text"])
    paths = [str(tmp_path / name) for name in ("totals", "checkpoint")]
    stream_usage(tail_lines(spark, str(log)), *paths).awaitTermination()
    _arrive(log / "run_id=b", "1.jsonl", [event(1)])
    _arrive(log / "run_id=a", "2.jsonl", [event(3)])
    stream_usage(tail_lines(spark, str(log)), *paths).awaitTermination()
    _arrive(log / "run_id=b", "3.jsonl", [event(2)])
    stream_usage(tail_lines(spark, str(log)), *paths).awaitTermination()
    written = {n: {r.run_id for r in spark.read.parquet(paths[0]).where(F.col("batch") == n).collect()} for n in range(3)}
    assert written == {0: {"a"}, 1: {"a", "b"}, 2: {"b"}}  # only the runs that grew
    last = latest_usage(spark, paths[0]).collect()
    found = {row.run_id: (row.observed_model_calls, row.invalid_lines, row.input_tokens_known_subtotal, float(row.estimated_cost_usd_known_subtotal)) for row in last}
    assert found == {"a": (3, 1, 30, 1.5), "b": (2, 0, 20, 1.0)}
