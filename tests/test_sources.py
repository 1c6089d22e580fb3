import json

import pytest
from pyspark.sql import functions as F

from sluice import fixed_values as V
from sluice.sources.export import export_results, exportable, write_report
from sluice.sources.files import file_fingerprints, load_messages, load_references, load_results, prompt_files, valid_prompts
from sluice.sources.runs import accounting_outcomes, load_runs, run_headers, run_outcomes

CONTENT = {"categoria": "bug", "prioridad": "alta", "area_sugerida": "data", "idioma": "es", "resumen": "r", "requiere_info": False, "pregunta_seguimiento": None}


def test_array_and_line_files(spark, tmp_path):
    rows = [{"id": f"k{n}", "source_area": "ops", "message": f"línea {n}"} for n in range(3)]
    (tmp_path / "array.json").write_text(json.dumps(rows, indent=2), encoding="utf-8")
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(row) for row in rows), encoding="utf-8")
    array = load_messages(spark, str(tmp_path / "array.json"), array=True).collect()
    lines = load_messages(spark, str(tmp_path / "lines.json")).collect()
    assert array == lines and len(array) == 3
    references = [{"id": "k1", "expected": CONTENT, "justification": "j"}]
    (tmp_path / "refs.json").write_text(json.dumps(references), encoding="utf-8")
    row = load_references(spark, str(tmp_path / "refs.json"), array=True).first()
    assert row.expected.categoria == "bug" and row.expected.pregunta_seguimiento is None


def test_prompts_need_a_version_name_and_content(spark, tmp_path):
    for name, text in (("v1", "uno\ndos\n"), ("v0", "x"), ("v12", "doce"), ("draft", "x"), ("v3", " \n")):
        (tmp_path / f"{name}.md").write_text(text, encoding="utf-8")
    found = {row.version: row.content for row in valid_prompts(prompt_files(spark, str(tmp_path))).collect()}
    assert found == {"v1": "uno\ndos\n", "v12": "doce"}
    prints = {row.name: row.sha256 for row in file_fingerprints(spark, str(tmp_path)).collect()}
    assert len(prints) == 5 and prints["v0.md"] == prints["draft.md"] != prints["v1.md"]


def test_run_snapshot(spark, tmp_path):
    metadata = {"model": "m", "attempt": 1, "input_tokens": 5, "output_tokens": 1, "cached_input_tokens": None, "latency_ms": 1.5, "estimated_cost_usd": "0.000123456789", "prompt_version": "v1"}
    run = {
        "schema_version": 1, "run_id": "r", "prompt_version": "v1", "inputs": {"prompt_sha256": "a"}, "execution": {"model": "m", "max_attempts": 3},
        "outcomes": [
            {"id": "k1", "state": "succeeded", "result": {"classification": {**CONTENT, "confianza": 1, "id": "k1", "version_prompt": "v1"}, "metadata": metadata}},
            {"id": "k2", "state": "failed", "failure_category": "timeout"}, {"id": "k3", "state": "pending"},
        ],
    }
    (tmp_path / "run.json").write_text(json.dumps(run, indent=2), encoding="utf-8")
    runs = load_runs(spark, str(tmp_path), array=True)
    rows = run_outcomes(runs).orderBy("position").collect()
    assert [(row.position, row.id, row.state) for row in rows] == [(0, "k1", "succeeded"), (1, "k2", "failed"), (2, "k3", "pending")]
    flat = accounting_outcomes(run_outcomes(runs)).where("id = 'k1'").first()
    assert f"{flat.meta_estimated_cost_usd:f}" == "0.000123456789" and flat.max_attempts == 3
    assert run_headers(runs).first().inputs.prompt_sha256 == "a"


def _outcomes(spark, states):
    names = (*V.CONTENT_FIELDS, "confianza")
    rows = [(i, state, "v1", "v1", *CONTENT.values(), 0.5) for i, state in states]
    kinds = ", ".join(f"{name} {'boolean' if name == 'requiere_info' else 'double' if name == 'confianza' else 'string'}" for name in names)
    table = spark.createDataFrame(rows, f"id string, state string, metadata_version string, prompt_version string, {kinds}")
    record = F.struct(*names, "id", F.col("prompt_version").alias("version_prompt"))
    return table.select("id", "state", "metadata_version", "prompt_version", F.when(F.col("state") == "succeeded", record).alias("classification"))


def test_export_is_complete_or_nothing(spark, tmp_path):
    expected = spark.createDataFrame([("b",), ("a",)], "id string")
    target = str(tmp_path / "out")
    for states in ([("a", "succeeded")], [("a", "succeeded"), ("b", "failed")], [("a", "succeeded"), ("b", "succeeded"), ("b", "succeeded")], [("a", "succeeded"), ("b", "succeeded"), ("c", "succeeded")]):
        assert not exportable(_outcomes(spark, states), expected).first().complete
        with pytest.raises(ValueError):
            export_results(_outcomes(spark, states), expected, target)
    done = _outcomes(spark, [("b", "succeeded"), ("a", "succeeded")])
    export_results(done, expected, target)
    rows = load_results(spark, target).collect()
    assert sorted(row.id for row in rows) == ["a", "b"]
    text = spark.read.text(target).first().value
    assert '"pregunta_seguimiento":null' in text and set(json.loads(text)) == set(V.CLASSIFICATION_FIELDS)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        export_results(done, expected, target)
    export_results(done, expected, target, overwrite=True)


def test_report_sections_are_folders(spark, tmp_path):
    part = spark.createDataFrame([("a", None), ("b", 2)], "id string, n int")
    write_report({"one": part, "two": part.where("n = 2")}, str(tmp_path / "report"))
    rows = spark.read.text(str(tmp_path / "report")).collect()
    assert sorted((row.section, row.value) for row in rows) == [("one", '{"id":"a","n":null}'), ("one", '{"id":"b","n":2}'), ("two", '{"id":"b","n":2}')]
