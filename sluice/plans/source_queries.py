"""File sources and sinks, each written by Spark from the given tables and read back."""

import pandas as pd
from pyspark.sql import functions as F

from sluice import fixed_values as V
from sluice.operators import evaluation as E
from sluice.plans.bindings import bind
from sluice.plans.catalog import query
from sluice.plans.evaluation_queries import ALL_OK, MISMATCH_SQL, SCORED
from sluice.sources import strict
from sluice.sources.export import export_results, write_report
from sluice.sources.files import load_messages, load_references, load_results
from sluice.sources.runs import load_runs, run_outcomes
from sluice.sources.workspace import new_folder

CONTENT = ", ".join(V.CONTENT_FIELDS)


@query("src_messages", "SELECT id, source_area, message FROM {messages}")
def src_messages(spark, sf_dir):
    path = new_folder(spark, "messages")
    bind(spark, sf_dir, "messages").write.json(path)
    return load_messages(spark, path)


@query("src_references", f"SELECT id, {CONTENT}, concat('por ', priority_text) AS justification FROM {{requests}}")
def src_references(spark, sf_dir):
    path = new_folder(spark, "references")
    bind(spark, sf_dir, "requests").select(
        "id", F.struct(*V.CONTENT_FIELDS).alias("expected"), F.concat(F.lit("por "), "priority_text").alias("justification")
    ).write.option("ignoreNullFields", "false").json(path)
    return load_references(spark, path).select("id", "expected.*", "justification")


RUN_ITEMS = ("succeeded", "failed", "pending")


@query(
    "run_outcomes",
    " UNION ALL ".join(
        f"SELECT concat('run-', key_number) AS run_id, CAST({place} AS BIGINT) AS position, concat(id, '-{place}') AS id, '{state}' AS state,"
        f" {'categoria' if state == 'succeeded' else 'CAST(NULL AS VARCHAR)'} AS categoria, {'1' if state == 'succeeded' else 'NULL'} AS attempt,"
        f" {'failure_code' if state == 'failed' else 'NULL'} AS failure_category FROM {{requests}}"
        for place, state in enumerate(RUN_ITEMS)
    ),
)
def outcomes(spark, sf_dir):
    """One snapshot document of three items per request, written and unnested. No grouping: each row is a run."""
    classification = F.struct(*V.CONTENT_FIELDS, "confianza", "id", F.lit("v1").alias("version_prompt"))
    metadata = F.struct(F.lit("model-a").alias("model"), F.lit(1).alias("attempt"), F.lit("v1").alias("prompt_version"))
    result = F.struct(classification.alias("classification"), metadata.alias("metadata"))
    items = [
        F.struct(
            F.concat("id", F.lit(f"-{place}")).alias("id"), F.lit(state).alias("state"),
            F.when(F.lit(state == "failed"), F.col("failure_code")).alias("failure_category"),
            F.when(F.lit(state == "succeeded"), result).alias("result"),
        )
        for place, state in enumerate(RUN_ITEMS)
    ]
    path = new_folder(spark, "runs")
    bind(spark, sf_dir, "requests").select(
        F.lit(V.ARTIFACT_VERSION).alias("schema_version"), F.concat(F.lit("run-"), "key_number").alias("run_id"),
        F.lit("v1").alias("prompt_version"), F.array(*items).alias("outcomes"),
    ).write.json(path)
    unnested = run_outcomes(load_runs(spark, path))
    return unnested.select(
        "run_id", F.col("position").cast("long").alias("position"), "id", "state", "result.classification.categoria",
        "result.metadata.attempt", "failure_category",
    )


@query("export_results", f"SELECT id, {CONTENT}, confianza, 'v1' AS version_prompt FROM {{requests}}")
def exported(spark, sf_dir):
    """A complete run exported in ID order and read back."""
    rows = bind(spark, sf_dir, "requests").withColumn("version_prompt", F.lit("v1"))
    outcomes_ = rows.select(
        "id", F.lit("succeeded").alias("state"), F.struct(*V.CLASSIFICATION_FIELDS).alias("classification"),
        F.lit("v1").alias("metadata_version"), F.lit("v1").alias("prompt_version"),
    )
    path = new_folder(spark, "results")
    export_results(outcomes_, rows.select("id"), path)
    return load_results(spark, path)


@query(
    "run_report",
    SCORED + f", x AS ({MISMATCH_SQL})"
    " SELECT 'failure_counts' AS section, CAST(json_object('state', state, 'failures', count(*)) AS VARCHAR) AS body FROM s WHERE NOT done GROUP BY state"
    f" UNION ALL SELECT 'exact_message_ids', CAST(json_object('id', id) AS VARCHAR) FROM s WHERE {ALL_OK}"
    " UNION ALL SELECT 'mismatches', CAST(json_object('id', id, 'field', field, 'expected', expected, 'actual', actual) AS VARCHAR) FROM x"
    " UNION ALL SELECT 'failures', CAST(json_object('id', id, 'state', state, 'category', CASE WHEN state = 'failed' THEN coalesce(failure_category, 'execution_error') END) AS VARCHAR) FROM s WHERE NOT done",
)
def report(spark, sf_dir):
    """Report sections written as their own folders and read back; every list stays a list of rows."""
    parts = E.score(bind(spark, sf_dir, "reference_labels"), bind(spark, sf_dir, "outcomes_v1"))
    sections = ("failure_counts", "exact_message_ids", "mismatches", "failures")
    path = new_folder(spark, "report")
    write_report({name: parts[name] for name in sections}, path)
    return spark.read.text(path).select("section", F.col("value").alias("body"))


@query(
    "src_messages_checked",
    "SELECT line AS record, CASE number % 9 WHEN 0 THEN 'type:id,unknown:extra' WHEN 1 THEN 'missing:message' WHEN 2 THEN 'blank:message,blank:source_area' WHEN 3 THEN 'not_json' ELSE '' END AS reasons,"
    " CASE WHEN number % 9 > 3 THEN concat('k', number) END AS id FROM {message_lines}",
)
def messages_checked(spark, sf_dir):
    """Lines of which some are no messages: typed rows and rejected ones, with every reason."""
    path = new_folder(spark, "message-lines")
    bind(spark, sf_dir, "message_lines").select("line").write.text(path)
    rows, rejected = strict.messages(spark, path)
    record = F.to_json(F.struct("id", "source_area", "message"))
    return rows.select(record.alias("record"), F.lit("").alias("reasons"), "id").unionByName(
        rejected.select("record", F.array_join(F.array_sort("reasons"), ",").alias("reasons"), F.lit(None).cast("string").alias("id"))
    )


def _as_array_file(batches):
    """The rows of a task as one pretty-printed array."""
    first = True
    for batch in batches:
        yield batch.assign(value=[("[" if first and k == 0 else ",") + "\n  " + v for k, v in enumerate(batch["value"])]) if len(batch) else batch
        first = first and not len(batch)
    yield pd.DataFrame({"value": ["[]" if first else "]"]})


RESULT_ROWS = "SELECT *, CASE WHEN key_number % 10 = 3 THEN 1.5 ELSE confianza END AS sure, CASE WHEN key_number % 10 = 4 THEN 'queja' ELSE categoria END AS label FROM {requests}"


@query(
    "src_results_checked",
    f"SELECT id, CASE WHEN key_number % 10 = 3 THEN 'confidence_range' WHEN key_number % 10 = 4 THEN 'enum:categoria' ELSE '' END AS reasons FROM ({RESULT_ROWS}) AS r",
)
def results_checked(spark, sf_dir):
    """Results in array files, cut at their records; some labels and confidences break the contract."""
    rows = spark.sql(RESULT_ROWS, requests=bind(spark, sf_dir, "requests"))
    fields = [F.col("label").alias("categoria") if n == "categoria" else F.col("sure").alias("confianza") if n == "confianza" else F.lit("v1").alias(n) if n == "version_prompt" else F.col(n) for n in V.CLASSIFICATION_FIELDS]
    records = rows.repartition(4).select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false", "pretty": "true"}).alias("value"))
    path = new_folder(spark, "result-arrays")
    records.mapInPandas(_as_array_file, "value string").write.text(path)
    good, rejected = strict.results(spark, path, array=True)
    return good.select("id", F.lit("").alias("reasons")).unionByName(
        rejected.select(F.get_json_object("record", "$.id").alias("id"), F.array_join(F.array_sort("reasons"), ",").alias("reasons"))
    )


COVERED = "SELECT key_number AS position, id, CASE WHEN key_number % 16 = 5 THEN '' ELSE raw_message END AS text, CASE WHEN key_number % 16 = 6 THEN key_number + 1 ELSE key_number END AS found FROM {requests}"


@query(
    "coverage_trials",
    f"WITH c AS ({COVERED}) SELECT id, CASE WHEN position % 16 = 4 THEN 'missing' WHEN position % 16 = 7 THEN 'duplicate' WHEN position % 16 = 5 THEN 'empty_text' WHEN position % 16 = 6 THEN 'out_of_order' ELSE 'ok' END AS status FROM c"
    " UNION ALL SELECT concat('x-', id), 'unexpected' FROM c WHERE position % 16 = 1",
)
def coverage_trials(spark, sf_dir):
    """Fixtures that are covered, and others in every way not."""
    rows = spark.sql(COVERED, requests=bind(spark, sf_dir, "requests"))
    there = rows.where("position % 16 <> 4").select("id", F.col("found").alias("position"), "text")
    strange = rows.where("position % 16 = 1").select(F.concat(F.lit("x-"), "id").alias("id"), "position", "text")
    twice = rows.where("position % 16 = 7").select("id", "position", "text")
    found = there.unionByName(twice).unionByName(strange)
    return E.check_coverage(rows.select("id", "position"), found, ["text"])
