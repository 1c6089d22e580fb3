"""Scoring, comparison and run guards."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice import fixed_values as V
from sluice.operators import comparison as X
from sluice.operators import evaluation as E
from sluice.operators import guards as G
from sluice.plans.bindings import bind
from sluice.plans.catalog import flags_sql, listed, query
from sluice.sources.files import row_fingerprints

FIELDS = V.SCORED_FIELDS


def scored_ctes(outcomes: str, name: str = "s") -> str:
    """Joined rows with one right/wrong flag per field, in plain SQL."""
    right = ", ".join(f"coalesce(state = 'succeeded' AND ref_{f} IS NOT DISTINCT FROM {f}, false) AS ok_{f}" for f in FIELDS)
    return (
        f"{name} AS (SELECT r.*, o.* EXCLUDE (id, state), coalesce(o.state, 'missing') AS state, coalesce(o.state = 'succeeded', false) AS done,"
        f" {right.replace('state =', 'o.state =')} FROM {{reference_labels}} AS r LEFT JOIN {{{outcomes}}} AS o ON r.id = o.id)"
    )


ALL_OK = " AND ".join(f"ok_{f}" for f in FIELDS)
SCORED = f"WITH {scored_ctes('outcomes_v1')} "


def _scored(spark, sf_dir, outcomes="outcomes_v1"):
    return E.score_join(bind(spark, sf_dir, "reference_labels"), bind(spark, sf_dir, outcomes))


@query("score_join", SCORED + f"SELECT id, state, {ALL_OK} AS exact, " + " + ".join(f"CAST(done AND NOT ok_{f} AS BIGINT)" for f in FIELDS) + " AS wrong FROM s")
def score_join(spark, sf_dir):
    return _scored(spark, sf_dir).select("id", "state", "exact", F.size("mismatches").cast("long").alias("wrong"))


MISMATCH_SQL = " UNION ALL ".join(
    f"SELECT id, '{f}' AS field, CAST(ref_{f} AS VARCHAR) AS expected, CAST({f} AS VARCHAR) AS actual FROM s WHERE done AND NOT ok_{f}"
    for f in FIELDS
)


@query("mismatch_array", SCORED + "SELECT id, " + flags_sql([(f, f"done AND NOT ok_{f}") for f in FIELDS]) + " AS wrong_fields FROM s")
def mismatch_array(spark, sf_dir):
    names = F.transform("mismatches", lambda entry: entry.getField("field"))
    return _scored(spark, sf_dir).select("id", listed(names).alias("wrong_fields"))


@query("mismatch_unnest", SCORED + MISMATCH_SQL)
def mismatch_unnest(spark, sf_dir):
    return E.mismatch_unnest(_scored(spark, sf_dir))


def accuracy_sql(field: str) -> str:
    return (
        f"SELECT '{field}' AS field, count(CASE WHEN ok_{field} THEN 1 END) AS correct, count(*) AS total,"
        f" round(count(CASE WHEN ok_{field} THEN 1 END) / count(*), 6) AS accuracy FROM s"
    )


@query("field_accuracy", SCORED + " UNION ALL ".join(accuracy_sql(f) for f in FIELDS))
def field_accuracy(spark, sf_dir):
    return E.field_accuracy(_scored(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 6))


RIGHT_SQL = " + ".join(f"CAST(ok_{f} AS BIGINT)" for f in FIELDS)


@query(
    "overall_accuracy",
    SCORED + f"SELECT CAST(sum({RIGHT_SQL}) AS BIGINT) AS correct, count(*) * 5 AS total, round(sum({RIGHT_SQL}) / (count(*) * 5), 6) AS accuracy FROM s",
)
def overall_accuracy(spark, sf_dir):
    return E.overall_accuracy(_scored(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 6))


@query(
    "all_five",
    SCORED + f"SELECT '' AS id, count(CASE WHEN {ALL_OK} THEN 1 END) AS correct, count(*) AS total FROM s"
    f" UNION ALL SELECT id, 1, 1 FROM s WHERE {ALL_OK}",
)
def all_five(spark, sf_dir):
    """The count, then the IDs behind it as rows."""
    scored = _scored(spark, sf_dir)
    count = E.all_five(scored).select(F.lit("").alias("id"), "correct", "total")
    one = F.lit(1).cast("long")
    return count.unionByName(E.exact_ids(scored).select("id", one.alias("correct"), one.alias("total")))


@query("failure_counts", SCORED + "SELECT state, count(*) AS failures FROM s WHERE NOT done GROUP BY state")
def failure_counts(spark, sf_dir):
    return E.failure_counts(_scored(spark, sf_dir))


@query(
    "failure_category_counts",
    SCORED + "SELECT coalesce(failure_category, 'execution_error') AS category, count(*) AS failures FROM s WHERE state = 'failed' GROUP BY 1",
)
def failure_category_counts(spark, sf_dir):
    return E.failure_category_counts(_scored(spark, sf_dir))


@query(
    "confidence_stats",
    SCORED + f""", g AS (SELECT CASE WHEN {ALL_OK} THEN 'exact' ELSE 'disagreement' END AS "group", confianza FROM s WHERE done)
    SELECT k."group", count(confianza) AS count, round(avg(confianza), 6) AS mean, round(median(confianza), 6) AS median
    FROM (VALUES ('exact'), ('disagreement')) AS k("group") LEFT JOIN g ON g."group" = k."group" GROUP BY k."group" """,
)
def confidence_stats(spark, sf_dir):
    stats = E.confidence_stats(_scored(spark, sf_dir))
    return stats.select("group", "count", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"))


@query("lowest_confidence", SCORED + "SELECT id, confianza AS confidence FROM s WHERE done ORDER BY confianza, id")
def lowest_confidence(spark, sf_dir):
    return E.lowest_confidence(_scored(spark, sf_dir))


@query(
    "highest_confidence_mistakes",
    SCORED + f"SELECT id, confianza AS confidence FROM s WHERE done AND NOT ({ALL_OK}) ORDER BY confianza DESC, id",
)
def highest_confidence_mistakes(spark, sf_dir):
    return E.highest_confidence_mistakes(_scored(spark, sf_dir))


@query(
    "outcome_split",
    "SELECT id, state, failure_category, coalesce(state = 'succeeded', false) AS succeeded FROM {outcomes_v1}",
)
def outcome_split(spark, sf_dir):
    good, bad = E.outcome_split(bind(spark, sf_dir, "outcomes_v1"))
    columns = ("id", "state", "failure_category")
    return good.select(*columns, F.lit(True).alias("succeeded")).unionByName(
        bad.select(*columns, F.lit(False).alias("succeeded"))
    )


@query(
    "results_as_outcomes",
    "SELECT id, 'succeeded' AS state, categoria, prioridad, area_sugerida, idioma, requiere_info, confianza FROM {requests} WHERE state = 'completed'",
)
def results_as_outcomes(spark, sf_dir):
    results = bind(spark, sf_dir, "requests").where(F.col("state") == "completed")
    return E.results_as_outcomes(results).drop("failure_category")


@query("missing_ids", "SELECT id FROM {reference_labels} WHERE id NOT IN (SELECT id FROM {outcomes_v1})")
def missing_ids(spark, sf_dir):
    return E.missing_ids(bind(spark, sf_dir, "reference_labels"), bind(spark, sf_dir, "outcomes_v1"))


@query("unexpected_ids", "SELECT DISTINCT id FROM {submissions} WHERE id NOT IN (SELECT id FROM {outcomes_v1})")
def unexpected_ids(spark, sf_dir):
    """Submitted IDs that no outcome knows; distinct first, so that hot IDs shrink before the join."""
    submitted = bind(spark, sf_dir, "submissions").select("id").distinct()
    return E.missing_ids(submitted, bind(spark, sf_dir, "outcomes_v1"))


@query("duplicate_ids", "SELECT id, count(*) AS rows FROM {submissions} GROUP BY id HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return E.duplicate_ids(bind(spark, sf_dir, "submissions"))


@query(
    "check_coverage",
    "WITH e AS (SELECT concat('r-', o_orderkey) AS id, o_orderkey AS position FROM {orders}),"
    " f AS (SELECT id, count(*) AS n, min(l_linenumber) AS position, max(CASE WHEN raw_message = 'NO' THEN 1 ELSE 0 END) AS blank FROM {submissions} GROUP BY id)"
    " SELECT coalesce(e.id, f.id) AS id, CASE WHEN f.id IS NULL THEN 'missing' WHEN e.id IS NULL THEN 'unexpected' WHEN n > 1 THEN 'duplicate'"
    " WHEN blank = 1 THEN 'empty_text' WHEN e.position <> f.position THEN 'out_of_order' ELSE 'ok' END AS status FROM e FULL JOIN f ON e.id = f.id",
)
def check_coverage(spark, sf_dir):
    expected = bind(spark, sf_dir, "orders").select(
        F.concat(F.lit("r-"), "o_orderkey").alias("id"), F.col("o_orderkey").alias("position")
    )
    text = F.when(F.col("raw_message") != "NO", F.col("raw_message")).otherwise(" ")
    found = bind(spark, sf_dir, "submissions").select("id", F.col("l_linenumber").alias("position"), text.alias("text"))
    return E.check_coverage(expected, found, ["text"])


BOTH = f"WITH {scored_ctes('outcomes_v1', 'b')}, {scored_ctes('outcomes_v2', 'c')} "


def _both(spark, sf_dir):
    return X.run_join(
        bind(spark, sf_dir, "reference_labels"), bind(spark, sf_dir, "outcomes_v1"), bind(spark, sf_dir, "outcomes_v2")
    )


def pairs_sql(minuend: str, subtrahend: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {minuend}.id, '{f}' AS field FROM {minuend} JOIN {subtrahend} ON {minuend}.id = {subtrahend}.id"
        f" WHERE {minuend}.done AND NOT {minuend}.ok_{f} AND NOT ({subtrahend}.done AND NOT {subtrahend}.ok_{f})"
        for f in FIELDS
    )


@query("run_join", BOTH + "SELECT b.id, " + flags_sql([(f, f"b.done AND NOT b.ok_{f}") for f in FIELDS]) + " AS baseline_wrong, " + flags_sql([(f, f"c.done AND NOT c.ok_{f}") for f in FIELDS]) + " AS candidate_wrong FROM b JOIN c ON b.id = c.id")
def run_join(spark, sf_dir):
    return _both(spark, sf_dir).select(
        "id", listed(F.col("baseline_wrong")).alias("baseline_wrong"), listed(F.col("candidate_wrong")).alias("candidate_wrong")
    )


@query("corrected", BOTH + pairs_sql("b", "c"))
def corrected(spark, sf_dir):
    return X.corrected(_both(spark, sf_dir))


@query("regressions", BOTH + pairs_sql("c", "b"))
def regressions(spark, sf_dir):
    return X.regressions(_both(spark, sf_dir))


def delta_sql(name: str, value: str) -> str:
    return f"SELECT '{name}' AS field, CAST((SELECT sum({value}) FROM c) - (SELECT sum({value}) FROM b) AS BIGINT) AS delta"


@query(
    "field_delta",
    BOTH + " UNION ALL ".join([*[delta_sql(f, f"CAST(ok_{f} AS BIGINT)") for f in FIELDS], delta_sql("overall", RIGHT_SQL)]),
)
def field_delta(spark, sf_dir):
    return X.field_delta(_both(spark, sf_dir))


@query(
    "resume_pending",
    "SELECT id, CASE WHEN state = 'running' THEN 'interrupted_unknown' ELSE state END AS state, state = 'pending' AS selected FROM {run_items}",
)
def resume_pending(spark, sf_dir):
    return G.resume_pending(bind(spark, sf_dir, "run_items")).select("id", "state", "selected")


@query(
    "fatal_cutoff",
    "WITH x AS (SELECT run_id, min(position) AS stop FROM {run_errors} WHERE error_type IN ('authentication', 'configuration') GROUP BY run_id)"
    " SELECT run_id, position, error_type, stop IS NULL OR position <= stop AS started FROM {run_errors} LEFT JOIN x USING (run_id)",
)
def fatal_cutoff(spark, sf_dir):
    return G.fatal_cutoff(bind(spark, sf_dir, "run_errors"), ["position"])


EXPECTED_SQL = "SELECT concat('run-', key_number % 97) AS run_id, count(*) AS expected_ids FROM {requests} GROUP BY 1"


def _expected(spark, sf_dir):
    return spark.sql(EXPECTED_SQL, requests=bind(spark, sf_dir, "requests"))


@query(
    "run_complete",
    f"WITH e AS ({EXPECTED_SQL}), r AS (SELECT run_id, count(DISTINCT id) AS d, count(*) AS n, bool_and(state = 'succeeded') AS ok FROM {{run_results}} GROUP BY run_id)"
    " SELECT run_id, expected_ids, coalesce(d, 0) AS distinct_ids, coalesce(d = expected_ids AND n = expected_ids AND ok, false) AS complete FROM e LEFT JOIN r USING (run_id)",
)
def run_complete(spark, sf_dir):
    return G.run_complete(bind(spark, sf_dir, "run_results"), _expected(spark, sf_dir))


@query(
    "single_version",
    "SELECT run_id, count(DISTINCT version_prompt) AS versions, count(DISTINCT model) AS models, count(DISTINCT version_prompt) <= 1 AND count(DISTINCT model) = 1 AS single"
    " FROM {run_results} WHERE state = 'succeeded' GROUP BY run_id",
)
def single_version(spark, sf_dir):
    return G.single_version(bind(spark, sf_dir, "run_results"))


# Outcomes of which some are given twice and some have no reference.
GIVEN = (
    "SELECT * FROM {outcomes_v1} UNION ALL SELECT * FROM {outcomes_v1} WHERE CAST(substr(id, 3) AS BIGINT) % 17 = 0"
    " UNION ALL SELECT concat('x-', id) AS id, state, failure_category, categoria, prioridad, area_sugerida, idioma, requiere_info, confianza FROM {outcomes_v1} WHERE CAST(substr(id, 3) AS BIGINT) % 19 = 0"
)
_RIGHT = ", ".join(f"coalesce(o.state = 'succeeded' AND ref_{f} IS NOT DISTINCT FROM {f}, false) AS ok_{f}" for f in FIELDS)
_DIFFERS = " UNION ALL ".join(
    f"SELECT 'mismatches', id, concat('{f}:', coalesce(CAST(ref_{f} AS VARCHAR), ''), ':', coalesce(CAST({f} AS VARCHAR), '')), CAST(NULL AS DOUBLE) FROM s WHERE done AND NOT ok_{f}" for f in FIELDS
)
_MEDIAN = "SELECT 'confidence', CASE WHEN {ok} THEN 'exact' ELSE 'disagreement' END, '{name}', {value} FROM s WHERE done GROUP BY 2"


@query(
    "score_report",
    f"WITH given AS ({GIVEN}), n AS (SELECT id, count(*) AS rows FROM given GROUP BY id), u AS (SELECT g.* FROM given AS g JOIN n USING (id) WHERE rows = 1),"
    f" s AS (SELECT r.*, o.* EXCLUDE (id, state), CASE WHEN rows > 1 THEN 'repeated' ELSE coalesce(o.state, 'missing') END AS state, coalesce(o.state = 'succeeded', false) AS done, {_RIGHT}"
    " FROM {reference_labels} AS r LEFT JOIN n ON n.id = r.id LEFT JOIN u AS o ON o.id = r.id)"
    + " UNION ALL ".join([
        *[f" SELECT 'fields' AS section, '{f}' AS name, '' AS detail, CAST(count(CASE WHEN ok_{f} THEN 1 END) AS DOUBLE) AS amount FROM s" for f in FIELDS],
        "SELECT 'overall_exact_fields', '', '', CAST(" + " + ".join(f"count(CASE WHEN ok_{f} THEN 1 END)" for f in FIELDS) + " AS DOUBLE) FROM s",
        f"SELECT 'all_five_fields', '', '', CAST(count(CASE WHEN {ALL_OK} THEN 1 END) AS DOUBLE) FROM s",
        f"SELECT 'exact_message_ids', id, '', NULL FROM s WHERE {ALL_OK}",
        _DIFFERS,
        "SELECT 'failures', id, concat(state, ':', CASE WHEN state = 'failed' THEN coalesce(failure_category, 'execution_error') ELSE '' END), NULL FROM s WHERE NOT done",
        "SELECT 'failure_counts', state, '', CAST(count(*) AS DOUBLE) FROM s WHERE NOT done GROUP BY state",
        "SELECT 'failure_category_counts', coalesce(failure_category, 'execution_error'), '', CAST(count(*) AS DOUBLE) FROM s WHERE state = 'failed' GROUP BY 2",
        _MEDIAN.format(ok=ALL_OK, name="count", value="CAST(count(*) AS DOUBLE)"), _MEDIAN.format(ok=ALL_OK, name="mean", value="round(avg(confianza), 9)"),
        _MEDIAN.format(ok=ALL_OK, name="median", value="round(median(confianza), 9)"),
        "SELECT 'lowest_successful', id, '', confianza FROM s WHERE done",
        f"SELECT 'highest_confidence_mistakes', id, '', confianza FROM s WHERE done AND NOT ({ALL_OK})",
        "SELECT 'refused', id, 'repeated', CAST(rows AS DOUBLE) FROM n WHERE rows > 1",
        "SELECT 'refused', id, 'unexpected', CAST(rows AS DOUBLE) FROM n WHERE id NOT IN (SELECT id FROM {reference_labels})",
    ]),
)
def score_report(spark, sf_dir):
    """All sections of the report of a run whose outcomes are partly refused, from one join."""
    given = spark.sql(GIVEN, outcomes_v1=bind(spark, sf_dir, "outcomes_v1"))
    parts = E.score(bind(spark, sf_dir, "reference_labels"), given)
    nothing, none = F.lit(""), F.lit(None).cast("double")
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    rows = {
        "fields": [("field", nothing, F.col("correct"))], "overall_exact_fields": [(None, nothing, F.col("correct"))], "all_five_fields": [(None, nothing, F.col("correct"))],
        "exact_message_ids": [("id", nothing, none)], "mismatches": [("id", F.concat_ws(":", "field", text("expected"), text("actual")), none)],
        "failures": [("id", F.concat_ws(":", "state", text("category")), none)], "failure_counts": [("state", nothing, F.col("failures"))],
        "failure_category_counts": [("category", nothing, F.col("failures"))],
        "confidence": [("group", F.lit(n), F.round(F.col(n).cast("double"), 9)) for n in ("count", "mean", "median")],
        "lowest_successful": [("id", nothing, F.col("confidence"))], "highest_confidence_mistakes": [("id", nothing, F.col("confidence"))],
        "refused": [("id", F.col("reason"), F.col("rows"))],
    }
    whole = [
        parts[section].select(F.lit(section).alias("section"), (F.col(name) if name else nothing).alias("name"), detail.alias("detail"), amount.cast("double").alias("amount"))
        for section, forms in rows.items() for name, detail, amount in forms
    ]
    return reduce(DataFrame.unionByName, whole)


HEADERS_SQL = (
    "SELECT DISTINCT run_id, run_number, CASE WHEN run_number % 19 = 0 THEN 2 ELSE 1 END AS schema_version, 'v1' AS prompt_version,"
    " concat('in-', run_number % 4) AS inputs, concat('ex-', run_number % 3) AS execution FROM {run_results}"
)
CURRENT_SQL = (
    "SELECT DISTINCT CASE WHEN run_number = 13 THEN 'run-renamed' ELSE run_id END AS run_id, CASE WHEN run_number % 5 = 0 THEN 'v2' ELSE 'v1' END AS prompt_version, 'in-1' AS inputs,"
    " CASE WHEN run_number % 7 = 0 THEN 'other' ELSE concat('ex-', run_number % 3) END AS execution FROM {run_results}"
)


@query(
    "resume_guard",
    f"WITH h AS ({HEADERS_SQL}), n AS ({CURRENT_SQL}), e AS ({EXPECTED_SQL}),"
    " d AS (SELECT run_id, count(*) AS items, count(CASE WHEN state = 'lost' THEN 1 END) AS bad,"
    "  count(CASE WHEN state = 'succeeded' AND (classification_id <> id OR metadata_version <> prompt_version) THEN 1 END) AS wrong FROM {run_checkpoints} GROUP BY run_id)"
    " SELECT h.run_id, " + flags_sql([
        ("schema_version", "h.schema_version <> 1"),
        ("run_id", "n.run_id IS NULL"),
        ("prompt_version", "n.run_id IS NOT NULL AND h.prompt_version <> n.prompt_version"),
        ("inputs", "n.run_id IS NOT NULL AND h.inputs <> n.inputs"),
        ("execution", "n.run_id IS NOT NULL AND h.execution <> n.execution"),
        ("item_count", "n.run_id IS NOT NULL AND d.items <> e.expected_ids"),
        ("item_fingerprint", "n.run_id IS NOT NULL AND d.items <> e.expected_ids"),
        ("checkpoint_state", "d.bad > 0"),
        ("checkpoint_provenance", "d.wrong > 0"),
    ]) + " AS reasons FROM h LEFT JOIN n USING (run_id) LEFT JOIN e USING (run_id) LEFT JOIN d USING (run_id)",
)
def resume_guard(spark, sf_dir):
    results = bind(spark, sf_dir, "run_results")
    checkpoints = bind(spark, sf_dir, "run_checkpoints").withColumn("position", F.col("key_number"))
    recorded = spark.sql(HEADERS_SQL, run_results=results).join(G.outcome_digest(checkpoints), "run_id", "left")
    planned = bind(spark, sf_dir, "requests").select(
        F.concat(F.lit("run-"), F.col("key_number") % 97).alias("run_id"), F.col("key_number").alias("position"), "id"
    )
    digest = planned.groupBy("run_id").agg(
        F.count("*").alias("item_count"),
        F.sum(F.xxhash64("position", "id").cast("decimal(38,0)")).alias("item_fingerprint"),
    )
    current = spark.sql(CURRENT_SQL, run_results=results).join(digest, "run_id", "left")
    return G.resume_guard(recorded, current).select("run_id", listed(F.col("reasons")).alias("reasons"))


@query("fingerprint", "SELECT doc_id, sha256(text) AS sha256 FROM {documents}")
def fingerprint(spark, sf_dir):
    return row_fingerprints(bind(spark, sf_dir, "documents"), "doc_id", "text")


RECORDED = (
    "concat('run-', source) AS run_id",
    "CASE WHEN lang = 'de' THEN concat('gone-', doc_id) ELSE concat('doc-', doc_id) END AS name",
)


@query(
    "drift_guard",
    f"SELECT {', '.join(RECORDED)}, CASE WHEN lang = 'de' THEN 'unknown_input' ELSE 'changed' END AS drift FROM {{documents}} WHERE lang = 'de' OR n_chars > 2000",
)
def drift_guard(spark, sf_dir):
    """Inputs recorded by runs against what the inputs hold now; long texts were revised since."""
    documents = bind(spark, sf_dir, "documents")
    old = F.when(F.col("n_chars") > 2000, F.concat("text", F.lit(" (old)"))).otherwise(F.col("text"))
    recorded = documents.withColumn("sha256", F.sha2(old, 256)).selectExpr(*RECORDED, "sha256")
    current = row_fingerprints(documents.withColumn("name", F.concat(F.lit("doc-"), "doc_id")), "name", "text")
    return G.drift_guard(recorded, current)


@query(
    "comparability",
    f"WITH e AS ({EXPECTED_SQL}), r AS (SELECT run_id, count(DISTINCT id) = any_value(expected_ids) AND bool_and(state = 'succeeded') AS complete,"
    "  count(DISTINCT model) AS models, min(model) AS model, count(DISTINCT version_prompt) = 1 AS provenance_ok, min(version_prompt) AS prompt_version FROM {run_results} JOIN e USING (run_id) GROUP BY run_id),"
    " n AS (SELECT DISTINCT run_number, run_id FROM {run_results}),"
    " h AS (SELECT r.*, run_number, concat('p-', run_number % 5 // 2) AS prompt_sha256, concat('m-', run_number // 40) AS messages_sha256, concat('x-', run_number // 25) AS execution FROM r JOIN n USING (run_id))"
    " SELECT n.run_id AS baseline, concat('run-', n.run_number + 1) AS candidate, " + flags_sql([
        ("unknown_run", "c.run_id IS NULL"),
        ("same_prompt_version", "b.prompt_version = c.prompt_version"),
        ("same_prompt_text", "b.prompt_sha256 = c.prompt_sha256"),
        ("fixtures_differ", "b.messages_sha256 <> c.messages_sha256"),
        ("settings_differ", "b.execution <> c.execution"),
        ("incomplete", "NOT (b.complete AND c.complete) AND c.run_id IS NOT NULL"),
        ("provenance", "NOT (b.provenance_ok AND c.provenance_ok) AND c.run_id IS NOT NULL"),
        ("models_differ", "c.run_id IS NOT NULL AND NOT (b.models = 1 AND c.models = 1 AND b.model = c.model)"),
    ]) + " AS reasons FROM n JOIN h AS b ON b.run_id = n.run_id LEFT JOIN h AS c ON c.run_id = concat('run-', n.run_number + 1)",
)
def comparability(spark, sf_dir):
    """Every run against the run after it."""
    results = bind(spark, sf_dir, "run_results")
    complete = G.run_complete(results, _expected(spark, sf_dir)).select("run_id", "complete")
    done = results.where(F.col("state") == "succeeded").groupBy("run_id").agg(
        F.countDistinct("model").alias("models"), F.min("model").alias("model"),
        (F.countDistinct("version_prompt") == 1).alias("provenance_ok"), F.min("version_prompt").alias("prompt_version"),
    )
    numbers = results.select("run_id", "run_number").distinct()
    number = F.col("run_number")
    runs = complete.join(done, "run_id").join(numbers, "run_id").select(
        "run_id", "complete", "models", "model", "provenance_ok", "prompt_version",
        F.concat(F.lit("p-"), F.floor(number % 5 / 2)).alias("prompt_sha256"),
        F.concat(F.lit("m-"), F.floor(number / 40)).alias("messages_sha256"),
        F.lit("refs").alias("references_sha256"),
        F.concat(F.lit("x-"), F.floor(number / 25)).alias("execution"),
    )
    pairs = numbers.select(
        F.col("run_id").alias("baseline"), F.concat(F.lit("run-"), number + 1).alias("candidate")
    )
    return G.comparability(pairs, runs).select("baseline", "candidate", listed(F.col("reasons")).alias("reasons"))
