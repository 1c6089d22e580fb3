"""Quarantining loaders against Python's own parser, and the cutting of array files in any layout."""

import json
import random

import pytest

from sluice.sources import strict

CONTENT = {"categoria": "bug", "prioridad": "alta", "area_sugerida": "data", "idioma": "es", "resumen": "dos palabras", "requiere_info": False, "pregunta_seguimiento": None}
RESULT = CONTENT | {"confianza": 0.5, "id": "k", "version_prompt": "v1"}


def _values(seed, count):
    rng = random.Random(seed)
    odd = ['}', '{', '[', ']', '"', '\\', '\\"', '},{', "línea\n", "😀", ", ", "", "}]", '\\\\"}']
    return [{"id": f"k{n}", "source_area": "".join(rng.choice(odd) for _ in range(rng.randint(0, 6))) or "x", "message": "m" + rng.choice(odd), "deep": {"a": [{"b": rng.choice(odd)}, {}]}} for n in range(count)]


@pytest.mark.parametrize("layout", [dict(indent=2), dict(indent=None), dict(indent=None, separators=(",", ":")), dict(indent=0)])
@pytest.mark.parametrize("split", [None, "200"])
def test_array_files_are_cut_at_their_records(spark, tmp_path, layout, split):
    rows = {f"{n}.json": _values(n, size) for n, size in enumerate((0, 1, 2, 57))}
    for name, values in rows.items():
        (tmp_path / name).write_text(json.dumps(values, **layout), encoding="utf-8")
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)  # a file is read in many blocks
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = strict.array_records(spark, str(tmp_path)).collect()
    finally:
        for name in ("maxPartitionBytes", "openCostInBytes"):
            spark.conf.unset(f"spark.sql.files.{name}")
    for name, values in rows.items():
        got = sorted((json.loads(r.record) for r in found if r.file.endswith(name)), key=lambda v: int(v["id"][1:]))
        assert got == values, name


def test_messages_and_what_is_wrong_with_them(spark, tmp_path):
    good = [{"id": "k1", "source_area": "ops", "message": "línea"}, {"id": "k2", "source_area": "}", "message": "{"}]
    bad = {
        '{"id":7,"source_area":"o","message":"m","extra":1}': ["unknown:extra", "type:id"], '{"id":"a","source_area":"o"}': ["missing:message"],
        '{"id":"a","source_area":" ","message":""}': ["blank:source_area", "blank:message"], '{"id":"a","source_area":"o","message":null}': ["type:message"],
        "[1]": ["not_an_object"], "nope": ["not_json"], '{"id":"a"} x': ["not_json"], '"text"': ["not_an_object"],
    }
    (tmp_path / "lines.json").write_text("\n\n".join([json.dumps(g) for g in good] + list(bad)) + "\n", encoding="utf-8")
    rows, rejected = strict.messages(spark, str(tmp_path / "lines.json"))
    assert sorted((r.id, r.source_area, r.message) for r in rows.collect()) == sorted(tuple(g.values()) for g in good)
    assert {r.record: sorted(r.reasons) for r in rejected.collect()} == {text: sorted(why) for text, why in bad.items()}
    objects = [text for text in bad if text.startswith("{") and text.endswith("}")]
    (tmp_path / "array.json").write_text("[" + ", ".join([json.dumps(g) for g in good] + objects) + "]")
    rows, rejected = strict.messages(spark, str(tmp_path / "array.json"), array=True)
    assert rows.count() == 2 and {r.record: sorted(r.reasons) for r in rejected.collect()} == {text: sorted(bad[text]) for text in objects}
    (tmp_path / "odd.json").write_text('[1, {"id":"a","source_area":"b","message":"c"}, "tail"]')
    rows, rejected = strict.messages(spark, str(tmp_path / "odd.json"), array=True)
    assert rows.count() == 0 and all(r.reasons == ["not_json"] for r in rejected.collect()) and rejected.count() == 2


def test_references_keep_the_content_contract(spark, tmp_path):
    def row(**change):
        return json.dumps({"id": "k", "expected": CONTENT, "justification": "j"} | change)

    cases = {
        row(): [], row(justification=" "): ["blank:justification"], row(expected=CONTENT | {"categoria": "queja"}): ["enum:categoria"],
        row(expected={k: v for k, v in CONTENT.items() if k != "resumen"}): ["expected.missing:resumen"], row(expected=CONTENT | {"x": 1}): ["expected.unknown:x"],
        row(expected=CONTENT | {"requiere_info": "no"}): ["expected.type:requiere_info"], row(expected=[1]): ["type:expected"],
        row(expected=CONTENT | {"requiere_info": True}): ["follow_up_required"], row(extra=None): ["unknown:extra"],
    }
    (tmp_path / "r.json").write_text("\n".join(cases), encoding="utf-8")
    rows, rejected = strict.references(spark, str(tmp_path))
    assert [r.expected.resumen for r in rows.collect()] == ["dos palabras"]
    assert {r.record: r.reasons for r in rejected.collect()} == {text: why for text, why in cases.items() if why}


def test_results_are_of_one_version_a_file(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps([RESULT, RESULT | {"id": "j", "confianza": 2}], indent=1))
    (tmp_path / "two.json").write_text(json.dumps([RESULT, RESULT | {"id": "j", "version_prompt": "v2"}]))
    (tmp_path / "none.json").write_text("[]")
    rows, rejected = strict.results(spark, str(tmp_path), array=True)
    assert [(r.id, r.confianza) for r in rows.collect()] == [("k", 0.5)]
    assert sorted(tuple(r.reasons) for r in rejected.collect()) == [("confidence_range",), ("mixed_versions",), ("mixed_versions",)]
