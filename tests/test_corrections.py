import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sluice import fixed_values as V
from sluice import schemas
from sluice.operators import corrections as K

START = datetime(2026, 3, 1)
LABELS = {"categoria": V.CATEGORIES, "prioridad": V.PRIORITIES, "area_sugerida": V.AREAS, "idioma": V.LANGUAGES}
BASE = {
    "categoria": "bug", "prioridad": "alta", "area_sugerida": "data", "idioma": "es", "resumen": "Resumen inicial",
    "requiere_info": False, "pregunta_seguimiento": None,
}


def _request(i, state, content):
    result = (*[content[name] for name in V.CONTENT_FIELDS], 0.5, i, "v1") if state == "completed" else None
    effective = (content["categoria"], content["prioridad"], content["area_sugerida"]) if result else (None, None, None)
    return (i, "text", state, result, None, None, *effective, None, START, START, START if result else None, None)


def _conforms(record):
    asked = record["pregunta_seguimiento"]
    return (
        all(record[name] in labels for name, labels in LABELS.items())
        and 1 <= len((record["resumen"] or "").split()) <= 20
        and record["requiere_info"] is not None
        and ((asked is not None and asked.strip() != "") if record["requiere_info"] else asked is None)
    )


def _random_change(dice):
    change = {}
    for name, labels in LABELS.items():
        if dice.random() < 0.15:
            change[name] = dice.choice([*labels, *labels, "malo"])
    if dice.random() < 0.2:
        change["resumen"] = dice.choice(["Otro texto", "", "x " * 21, "corto"])
    if dice.random() < 0.5:
        change["requiere_info"] = dice.choice([True, False])
    if dice.random() < 0.5:
        change["pregunta_seguimiento"] = dice.choice(["¿Cuál?", None, None, " ", "¿Dónde?"])
    return change


def _table(spark, rows):
    fields = ", ".join(
        f"has_{name} boolean, {name} {'boolean' if name == 'requiere_info' else 'string'}" for name in V.CONTENT_FIELDS
    )
    data = []
    for i, ts, seq, change in rows:
        flat = [value for name in V.CONTENT_FIELDS for value in (name in change, change.get(name))]
        data.append((i, ts, seq, *flat))
    return spark.createDataFrame(data, f"id string, ts timestamp, seq long, {fields}")


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_fold_equals_one_by_one_with_a_hot_id(spark, ranges):
    dice = random.Random(11)
    asking = {**BASE, "requiere_info": True, "pregunta_seguimiento": "¿Qué?"}
    starts = {"hot": ("completed", BASE), "a": ("completed", asking), "b": ("processing", BASE), "c": ("completed", BASE)}
    rows = [
        (dice.choice(["hot"] * 6 + ["a", "b", "c", "ghost"]), START + timedelta(seconds=dice.randint(0, 40_000)), n, _random_change(dice))
        for n in range(900)
    ]
    state, rejected = {i: dict(content) for i, (_, content) in starts.items()}, set()
    for i, ts, seq, change in sorted(rows, key=lambda row: (row[1], row[2])):
        merged = {**state[i], **change} if i in starts else None
        if not change or merged is None or starts[i][0] != "completed" or not _conforms(merged):
            rejected.add(seq)
        else:
            state[i] = merged
    requests = spark.createDataFrame([_request(i, s, c) for i, (s, c) in starts.items()], schemas.REQUEST)
    folded, refused = K.fold_corrections(requests, _table(spark, rows), ranges)
    assert {row.seq for row in refused.collect()} == rejected
    assert 100 < len(rejected) < 800
    found = {row.id: row for row in folded.collect()}
    for i in ("hot", "a", "c"):
        assert found[i].human_correction.asDict() == state[i]
        assert found[i].effective_category == state[i]["categoria"]
        assert found[i].ai_classification.categoria == starts[i][1]["categoria"]
        assert found[i].corrected_at is not None and found[i].created_at == START
    assert found["b"].human_correction is None


def test_reasons(spark):
    requests = spark.createDataFrame([_request("r", "completed", BASE), _request("p", "processing", BASE)], schemas.REQUEST)
    changes = [
        ("r", "{}", "shape"), ("r", '{"confianza":1}', "shape"), ("r", '{"categoria":7}', "shape"), ("r", '{"categoria":null}', "shape"),
        ("r", '{"categoria":"malo"}', "invalid_label"), ("r", '{"resumen":"no aceptado"}', "summary_language"),
        ("r", '{"resumen":"aceptado"}', None), ("r", '{"requiere_info":true}', "follow_up"),
        ("r", '{"requiere_info":true,"pregunta_seguimiento":"¿?"}', None), ("r", '{"pregunta_seguimiento":null}', "follow_up"),
        ("r", '{"requiere_info":false,"pregunta_seguimiento":null}', None), ("p", '{"categoria":"bug"}', "not_completed"),
        ("x", '{"categoria":"bug"}', "not_found"), ("x", "{}", "shape"),
    ]
    rows = spark.createDataFrame(
        [(i, START + timedelta(minutes=n), n, text, "no" not in text) for n, (i, text, _) in enumerate(changes)],
        "id string, ts timestamp, seq long, changes string, summary_accepted boolean",
    )
    judged = K.judge_corrections(requests, K.parse_corrections(rows))
    found = {row.seq: row.reason for row in judged.collect()}
    assert [found[n] for n in range(len(changes))] == [reason for _, _, reason in changes]


def test_second_fold_starts_from_the_first(spark):
    requests = spark.createDataFrame([_request("r", "completed", BASE)], schemas.REQUEST)
    first, _ = K.fold_corrections(requests, _table(spark, [("r", START, 1, {"categoria": "datos", "prioridad": "media"})]))
    second, refused = K.fold_corrections(first, _table(spark, [("r", START + timedelta(days=1), 2, {"area_sugerida": "devops"})]))
    row = second.first()
    assert refused.count() == 0
    assert (row.effective_category, row.effective_priority, row.effective_area) == ("datos", "media", "devops")
    assert row.corrected_at == START + timedelta(days=1) == row.updated_at
    assert row.ai_classification.categoria == "bug"


def test_policy_turns_summaries_in_another_language_away(spark):
    requests = spark.createDataFrame([_request("r", "completed", BASE)], schemas.REQUEST)
    changes = [{"resumen": "pago doble"}, {"resumen": "english words"}, {"prioridad": "baja"}, {"resumen": "pago doble", "categoria": "datos"}]
    rows = _table(spark, [("r", START + timedelta(minutes=n), n, change) for n, change in enumerate(changes)] + [("nobody", START, 9, {"prioridad": "alta"})])
    seen = []

    def policy(summaries):
        seen.append(summaries.count())
        return summaries.select("id", (~F.col("resumen").startswith("english")).alias("summary_accepted"))

    folded, rejected = K.fold_corrections(requests, rows, policy=policy)
    assert {(r.seq, r.reason) for r in rejected.collect()} == {(1, "summary_language"), (9, "not_found")} and seen == [2]
    final = folded.first().human_correction
    assert (final.resumen, final.prioridad, final.categoria) == ("pago doble", "baja", "datos")
