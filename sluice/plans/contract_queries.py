"""Contract validation, JSON shapes, cost and delay."""

from pyspark.sql import functions as F

from sluice import fixed_values as V
from sluice.functions import contract as C
from sluice.functions import json_shape as J
from sluice.functions.money import backoff_delay, token_cost
from sluice.operators.classification import parse_answers, validate_classifications
from sluice.operators.corrections import judge_corrections, parse_corrections
from sluice.plans.bindings import bind, bind_spread, stored_requests
from sluice.plans.catalog import blank_sql, flags_sql, in_sql, listed, query, stamp, stamp_sql, words_sql
from sluice.sources.store import encode_json


def outside_sql(value, domain):
    return f"NOT coalesce({in_sql(value, domain)}, false)"


def enum_sql():
    return [(f"enum:{name}", outside_sql(name, domain)) for name, domain in C.DOMAINS.items()]


SUMMARY_SQL = [("summary_words", f"NOT coalesce({words_sql('resumen')} BETWEEN 1 AND 20, false)")]
FOLLOW_UP_SQL = [
    ("needs_info_missing", "requiere_info IS NULL"),
    (
        "follow_up_required",
        f"requiere_info AND (pregunta_seguimiento IS NULL OR {blank_sql('pregunta_seguimiento')})",
    ),
    ("follow_up_forbidden", "NOT requiere_info AND pregunta_seguimiento IS NOT NULL"),
]
CONFIDENCE_SQL = [
    ("confidence_range", "NOT coalesce(confianza >= 0 AND confianza <= 1 AND NOT isnan(confianza), false)"),
]
IDENTIFIER_SQL = [
    (f"blank:{name}", f"coalesce({blank_sql(name)}, true)") for name in ("id", "version_prompt")
]
ALL_SQL = [*enum_sql(), *SUMMARY_SQL, *FOLLOW_UP_SQL, *CONFIDENCE_SQL, *IDENTIFIER_SQL]


def _checked(source, key, flags):
    def run(spark, sf_dir):
        return bind(spark, sf_dir, source).select(key, listed(C.violations(flags())).alias("violations"))

    return run


for _name, _flags, _sql in (
    ("check_enums", C.enum_flags, enum_sql()),
    ("check_summary_words", C.summary_flags, SUMMARY_SQL),
    ("check_follow_up", C.follow_up_flags, FOLLOW_UP_SQL),
    ("check_confidence", C.confidence_flags, CONFIDENCE_SQL),
    ("check_identifiers", C.identifier_flags, IDENTIFIER_SQL),
):
    query(_name, f"SELECT row_id, {flags_sql(_sql)} AS violations FROM {{candidates}}")(
        _checked("candidates", "row_id", _flags)
    )

query(
    "check_usage",
    "SELECT id, " + flags_sql([
        ("usage_pair", "(input_tokens IS NULL) <> (output_tokens IS NULL)"),
        ("cached_without_input", "cached_input_tokens IS NOT NULL AND input_tokens IS NULL"),
        ("cached_exceeds_input", "cached_input_tokens > input_tokens"),
        ("negative_usage", "input_tokens < 0 OR output_tokens < 0 OR cached_input_tokens < 0"),
        ("attempt_range", "coalesce(attempt < 1, true)"),
        ("negative_latency", "coalesce(latency_ms < 0, true)"),
        ("negative_cost", "estimated_cost_usd < 0"),
    ]) + " AS violations FROM {call_metadata}",
)(_checked("call_metadata", "id", C.usage_flags))

query(
    "check_pricing",
    "SELECT id, " + flags_sql([
        ("price_pair", "(input_per_million IS NULL) <> (output_per_million IS NULL)"),
        (
            "cached_without_prices",
            "cached_input_per_million IS NOT NULL AND (input_per_million IS NULL OR output_per_million IS NULL)",
        ),
        ("negative_price", "input_per_million < 0 OR output_per_million < 0 OR cached_input_per_million < 0"),
    ]) + " AS violations FROM {price_rows}",
)(_checked("price_rows", "id", C.pricing_flags))

query(
    "check_request_state",
    "SELECT id, " + flags_sql([
        ("state_domain", outside_sql("state", V.REQUEST_STATES)),
        (
            "effective_domain",
            f"(effective_category IS NOT NULL AND NOT {in_sql('effective_category', V.CATEGORIES)})"
            f" OR (effective_priority IS NOT NULL AND NOT {in_sql('effective_priority', V.PRIORITIES)})"
            f" OR (effective_area IS NOT NULL AND NOT {in_sql('effective_area', V.AREAS)})",
        ),
        (
            "completed_without_result",
            "state = 'completed' AND (ai_classification IS NULL OR provider_metadata IS NULL OR classified_at IS NULL)",
        ),
        (
            "completed_without_effective",
            "state = 'completed' AND (effective_category IS NULL OR effective_priority IS NULL OR effective_area IS NULL)",
        ),
        ("completed_with_failure", "state = 'completed' AND failure_code IS NOT NULL"),
        (
            "open_with_result",
            "state <> 'completed' AND (ai_classification IS NOT NULL OR human_correction IS NOT NULL"
            " OR provider_metadata IS NOT NULL OR classified_at IS NOT NULL)",
        ),
        ("correction_without_time", "human_correction IS NOT NULL AND corrected_at IS NULL"),
        ("failed_without_code", "state = 'failed' AND failure_code IS NULL"),
        ("processing_with_code", "state = 'processing' AND failure_code IS NOT NULL"),
    ]) + " AS violations FROM {request_rows}",
)(_checked("request_rows", "id", C.request_state_flags))

CODE_SQL = "CASE WHEN key_number % 3 = 0 THEN failure_code WHEN key_number % 3 = 1 THEN priority_text ELSE concat(categoria, '_', prioridad) END"


@query(
    "check_failure_code",
    f"SELECT id, CASE WHEN coalesce(regexp_full_match({CODE_SQL}, '[a-z_]+'), false) THEN '' ELSE 'failure_code' END"
    " AS violations FROM {requests}",
)
def check_failure_code(spark, sf_dir):
    rows = bind(spark, sf_dir, "requests").withColumn("failure_code", F.expr(CODE_SQL))
    return rows.select("id", listed(C.violations(C.failure_code_flags())).alias("violations"))


query(
    "check_outcome_state",
    f"SELECT id, CASE WHEN {outside_sql('state', V.OUTCOME_STATES)} THEN 'state_domain' ELSE '' END AS violations"
    " FROM {run_checkpoints}",
)(_checked("run_checkpoints", "id", C.outcome_state_flags))


@query(
    "check_provenance",
    "SELECT id, " + flags_sql([
        ("id_differs", "id IS DISTINCT FROM classification_id"),
        ("metadata_version_differs", "prompt_version IS DISTINCT FROM metadata_version"),
        ("run_version_differs", "prompt_version IS DISTINCT FROM version_prompt"),
    ]) + " AS violations FROM (SELECT c.*, r.version_prompt FROM {run_checkpoints} AS c JOIN {run_results} AS r USING (id)) AS j"
    " WHERE state = 'succeeded'",
)
def check_provenance(spark, sf_dir):
    checkpoints = bind(spark, sf_dir, "run_checkpoints")
    versions = bind(spark, sf_dir, "run_results").select("id", "version_prompt")
    rows = checkpoints.join(versions, "id").where(F.col("state") == "succeeded")
    flags = C.provenance_flags(
        F.col("id"), F.col("classification_id"), F.col("prompt_version"), F.col("metadata_version"),
        F.col("version_prompt"),
    )
    return rows.select("id", listed(C.violations(flags)).alias("violations"))


@query(
    "validate_classifications",
    f"SELECT row_id, {flags_sql(ALL_SQL)} AS violations, {flags_sql(ALL_SQL)} = '' AS valid FROM {{candidates}}",
)
def validated(spark, sf_dir):
    """Valid and quarantined rows, both kept."""
    good, bad = validate_classifications(bind_spread(spark, sf_dir, "candidates"))
    kept = good.select("row_id", F.lit("").alias("violations"), F.lit(True).alias("valid"))
    return kept.unionByName(bad.select("row_id", listed(F.col("violations")).alias("violations"), F.lit(False).alias("valid")))


DUCK_KIND = {
    "STRING": ("VARCHAR",), "BOOLEAN": ("BOOLEAN",), "VOID": ("NULL",), "BIGINT": ("UBIGINT", "BIGINT"),
    "DECIMAL": ("DOUBLE",), "DOUBLE": ("DOUBLE",),
}


def shape_sql(text: str, types, partial: bool = False) -> str:
    """The shape check with DuckDB's own JSON functions."""
    valid = f"CASE WHEN json_valid({text}) THEN {text} END"
    names = "[" + ", ".join(f"'{name}'" for name in types) + "]"
    keys = f"json_keys({valid})"
    unknown = f"list_transform(list_sort(list_filter({keys}, lambda key: NOT list_contains({names}, key))), lambda key: concat('unknown:', key))"
    wrong = []
    for name, allowed in types.items():
        kinds = [kind for option in allowed for kind in DUCK_KIND[option]]
        kind = f"json_type({valid}, '$.{name}')"
        wrong.append(f"CASE WHEN {kind} IS NOT NULL AND NOT {in_sql(kind, kinds)} THEN 'type:{name}' END")
    bad = f"list_filter([{', '.join(wrong)}], lambda x: x IS NOT NULL)"
    if partial:
        first = f"CASE WHEN len({keys}) = 0 THEN ['empty'] ELSE CAST([] AS VARCHAR[]) END"
    else:
        first = f"list_transform(list_filter({names}, lambda name: NOT list_contains({keys}, name)), lambda name: concat('missing:', name))"
    return (
        f"CASE WHEN json_type({valid}) = 'OBJECT' THEN array_to_string(list_concat({first}, {unknown}, {bad}), ',')"
        " ELSE 'not_an_object' END"
    )


@query("check_shape", f"SELECT id, {shape_sql('answer', J.ANSWER_TYPES)} AS violations FROM {{answers}}")
def check_shape(spark, sf_dir):
    rows = bind_spread(spark, sf_dir, "answers").withColumn("value", J.parse_strict(F.col("answer")))
    return rows.select("id", listed(J.shape_flags(F.col("answer"), F.col("value"), J.ANSWER_TYPES)).alias("violations"))


@query(
    "parse_answer",
    f"WITH a AS (SELECT id, answer, {shape_sql('answer', J.ANSWER_TYPES)} AS violations FROM {{answers}}) SELECT id, violations, "
    + ", ".join(
        f"CASE WHEN violations = '' THEN answer ->> '$.{name}' END AS {name}" for name in V.CONTENT_FIELDS if name != "requiere_info"
    )
    + ", CASE WHEN violations = '' THEN CAST(answer ->> '$.requiere_info' AS BOOLEAN) END AS requiere_info"
    + ", CASE WHEN violations = '' THEN CAST(answer ->> '$.confianza' AS DOUBLE) END AS confianza FROM a",
)
def parse_answer(spark, sf_dir):
    parsed = parse_answers(bind_spread(spark, sf_dir, "answers"))
    return parsed.select("id", listed(F.col("shape_violations")).alias("violations"), *J.ANSWER_TYPES)


@query(
    "check_submission",
    f"WITH s AS (SELECT row_id, payload, {shape_sql('payload', J.SUBMISSION_TYPES)} AS shape FROM {{payloads}})"
    " SELECT row_id, CASE WHEN shape <> '' THEN shape ELSE "
    + flags_sql([
        ("blank:id", f"coalesce({blank_sql('''payload ->> '$.id' ''')}, true)"),
        ("blank:message", f"coalesce({blank_sql('''payload ->> '$.mensaje' ''')}, true)"),
    ])
    + " END AS violations FROM s",
)
def check_submission(spark, sf_dir):
    rows = bind_spread(spark, sf_dir, "payloads").withColumn("value", J.parse_strict(F.col("payload")))
    rows = rows.select(
        "row_id",
        J.shape_flags(F.col("payload"), F.col("value"), J.SUBMISSION_TYPES).alias("shape"),
        F.try_variant_get("value", "$.id", "string").alias("id"),
        F.try_variant_get("value", "$.mensaje", "string").alias("message"),
    )
    flags = F.when(F.size("shape") > 0, F.col("shape")).otherwise(C.violations(C.submission_flags()))
    return rows.select("row_id", listed(flags).alias("violations"))


@query(
    "forbidden_fields",
    "SELECT id, seq, array_to_string(list_sort(list_filter(json_keys(changes), lambda key: NOT list_contains(["
    + ", ".join(f"'{name}'" for name in V.CONTENT_FIELDS)
    + "], key))), ',') AS forbidden FROM {change_sets}",
)
def forbidden_fields(spark, sf_dir):
    return bind_spread(spark, sf_dir, "change_sets").select("id", "seq", listed(J.unknown_keys(F.col("changes"))).alias("forbidden"))


# The brute-force form: every change set of an ID is judged in turn against the record left by the one before.
CHANGE_ORACLE = f"""
    WITH RECURSIVE c AS (
        SELECT id, ts, seq, changes, {shape_sql('changes', J.CONTENT_TYPES, partial=True)} AS shape,
               row_number() OVER (PARTITION BY id ORDER BY ts, seq) AS n,
               list_contains(json_keys(changes), 'requiere_info') AS hr, list_contains(json_keys(changes), 'pregunta_seguimiento') AS hq,
               coalesce(CAST(CASE WHEN json_type(changes, '$.requiere_info') = 'BOOLEAN' THEN changes ->> '$.requiere_info' END AS BOOLEAN), false) AS r,
               changes ->> '$.pregunta_seguimiento' AS q,
               coalesce(changes ->> '$.prioridad', 'alta') <> 'urgente' AS labels_ok
        FROM {{change_sets}}),
    fold AS (
        SELECT id, CAST(0 AS BIGINT) AS n, requiere_info AS r, pregunta_seguimiento AS q, state, CAST('' AS VARCHAR) AS reason, CAST(0 AS BIGINT) AS seq
        FROM {{requests}}
        UNION ALL
        SELECT id, n, CASE WHEN reason = '' THEN nr ELSE r END, CASE WHEN reason = '' THEN nq ELSE q END, state, reason, seq FROM (
            SELECT f.id, c.n, f.r, f.q, f.state, c.seq,
                   CASE WHEN c.hr THEN c.r ELSE f.r END AS nr, CASE WHEN c.hq THEN c.q ELSE f.q END AS nq,
                   CASE WHEN c.shape <> '' THEN 'shape' WHEN f.state <> 'completed' THEN 'not_completed' WHEN NOT c.labels_ok THEN 'invalid_label'
                        WHEN (CASE WHEN c.hr THEN c.r ELSE f.r END) <> ((CASE WHEN c.hq THEN c.q ELSE f.q END) IS NOT NULL) THEN 'follow_up'
                        ELSE '' END AS reason
            FROM fold AS f JOIN c ON c.id = f.id AND c.n = f.n + 1) AS s)
    SELECT id, seq, reason FROM fold WHERE n > 0"""


@query("check_correction", CHANGE_ORACLE)
def check_correction(spark, sf_dir):
    requests = stored_requests(bind(spark, sf_dir, "requests"))
    judged = judge_corrections(requests, parse_corrections(bind_spread(spark, sf_dir, "change_sets")))
    return judged.select("id", "seq", F.coalesce("reason", F.lit("")).alias("reason"))


@query(
    "encode_json",
    "SELECT id, CAST(json_object('categoria', categoria, 'requiere_info', requiere_info, 'pregunta_seguimiento', pregunta_seguimiento) AS VARCHAR)"
    " AS encoded FROM {requests}",
)
def encoded(spark, sf_dir):
    record = F.struct("categoria", "requiere_info", "pregunta_seguimiento")
    return bind(spark, sf_dir, "requests").select("id", encode_json(record).alias("encoded"))


USED = "coalesce(cached_input_tokens, 0)"
COST_SQL = f"""CASE WHEN input_tokens IS NULL OR output_tokens IS NULL OR input_per_million IS NULL OR output_per_million IS NULL THEN NULL
    WHEN least(input_tokens, output_tokens, {USED}) < 0 OR {USED} > input_tokens THEN NULL
    WHEN {USED} <> 0 AND cached_input_per_million IS NULL THEN NULL
    ELSE CAST((input_tokens - {USED}) * CAST(round(input_per_million * 100) AS BIGINT)
        + {USED} * coalesce(CAST(round(cached_input_per_million * 100) AS BIGINT), 0)
        + output_tokens * CAST(round(output_per_million * 100) AS BIGINT) AS BIGINT) END"""


@query(
    "token_cost",
    f"SELECT call_id, l_linenumber, l_suppkey, l_extendedprice, {stamp_sql('l_shipdate')} AS shipped, {COST_SQL} AS cost_e8"
    " FROM {calls} LEFT JOIN {pricing} USING (model)",
)
def token_costs(spark, sf_dir):
    """Cost of every call in whole units of 1e-8."""
    priced = token_cost(bind(spark, sf_dir, "calls"), bind(spark, sf_dir, "pricing"))
    return priced.select(
        "call_id", "l_linenumber", "l_suppkey", "l_extendedprice", stamp(F.col("l_shipdate")).alias("shipped"),
        (F.col("cost_usd") * 100_000_000).cast("long").alias("cost_e8"),
    )


@query(
    "cost_projection",
    f"WITH c AS (SELECT model, {COST_SQL} AS cost FROM {{calls}} LEFT JOIN {{pricing}} USING (model)),"
    " g AS (SELECT model, count(cost) AS calls, CAST(sum(cost) AS DOUBLE) AS total FROM c GROUP BY model)"
    " SELECT model, calls, round(total / 1e8, 6) AS batch_cost, round(total / calls / 1e8, 6) AS message_cost,"
    " round(total / calls * 500 / 1e8, 4) AS cost_500, round(total / calls * 50000 / 1e8, 2) AS cost_50000 FROM g",
)
def cost_projection(spark, sf_dir):
    """Known cost per model, per message and for larger volumes."""
    priced = token_cost(bind(spark, sf_dir, "calls"), bind(spark, sf_dir, "pricing"))
    totals = priced.groupBy("model").agg(
        F.count("cost_usd").alias("calls"), (F.sum("cost_usd") * 100_000_000).cast("double").alias("total")
    )
    return totals.select(
        "model", "calls",
        F.round(F.col("total") / 1e8, 6).alias("batch_cost"),
        F.round(F.try_divide("total", "calls") / 1e8, 6).alias("message_cost"),
        F.round(F.try_divide("total", "calls") * 500 / 1e8, 4).alias("cost_500"),
        F.round(F.try_divide("total", "calls") * 50000 / 1e8, 2).alias("cost_50000"),
    )


@query(
    "backoff_delay",
    "SELECT line, attempt, least(0.5 * pow(2, attempt - 1), 8.0) AS delay FROM {attempts} WHERE attempt >= 1",
)
def delays(spark, sf_dir):
    attempts = bind(spark, sf_dir, "attempts").where(F.col("attempt") >= 1)
    return attempts.select("line", "attempt", backoff_delay(F.col("attempt")).alias("delay"))
