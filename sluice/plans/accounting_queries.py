"""Attempts: resolution, log reading and usage accounting."""

from pyspark.sql import functions as F

from sluice import fixed_values as V
from sluice.operators import accounting as A
from sluice.operators.attempts import error_dimension, kind_of_status, resolve_attempts
from sluice.plans.bindings import bind
from sluice.plans.catalog import query
from sluice.sources.attempt_log import attempt_log_rows, read_attempt_log
from sluice.sources.workspace import new_folder


def _events(spark, sf_dir):
    return bind(spark, sf_dir, "attempts"), bind(spark, sf_dir, "run_items")


RETRYABLE = ", ".join(f"'{kind}'" for kind, retryable, _ in V.ERROR_KINDS if retryable)
STATUS = "400 + k % 30 + CASE WHEN k > 80 THEN 100 ELSE 0 END"


@query(
    "error_dimension",
    f"WITH e AS (SELECT line, CAST({STATUS} AS BIGINT) AS status FROM {{attempt_numbers}}),"
    " m AS (SELECT line, status, CASE WHEN status IN (401, 403) THEN 'authentication' WHEN status = 429 THEN 'rate_limit'"
    "  WHEN status IN (408, 409) OR status >= 500 THEN 'server_error' WHEN status IN (400, 404, 422) THEN 'configuration' ELSE 'provider_error' END AS error_type FROM e)"
    f" SELECT line, status, error_type, error_type IN ({RETRYABLE}) AS retryable, error_type IN ('authentication', 'configuration') AS fatal FROM m",
)
def errors(spark, sf_dir):
    """Status of failed calls to failure kind, retryable or not, fatal or not."""
    calls = bind(spark, sf_dir, "attempt_numbers").selectExpr("line", f"CAST({STATUS} AS BIGINT) AS status")
    kinds = calls.withColumn("error_type", kind_of_status(F.col("status")))
    return kinds.join(error_dimension(spark), "error_type", "left").select("line", "status", "error_type", "retryable", "fatal")


@query(
    "attempt_resolution",
    "WITH a AS (SELECT concat(run_id, '/', message_id) AS id, line, attempt, coalesce(success, false) AS ok, error_type FROM {attempts} WHERE attempt BETWEEN 1 AND 3),"
    f" o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY attempt, line) AS n, ok OR NOT coalesce(error_type IN ({RETRYABLE}), false) AS stop FROM a),"
    " b AS (SELECT *, coalesce(max(CASE WHEN stop THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM o),"
    " f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC) AS back FROM b WHERE stopped = 0)"
    " SELECT id, CASE WHEN ok THEN 'succeeded' ELSE 'failed' END AS state, attempt,"
    " CASE WHEN NOT ok THEN coalesce(error_type, 'unexpected_error') END AS failure_category FROM f WHERE back = 1",
)
def attempt_resolution(spark, sf_dir):
    attempts = bind(spark, sf_dir, "attempts").withColumn("id", F.concat_ws("/", "run_id", "message_id"))
    return resolve_attempts(attempts)


@query("attempt_log_rows", "SELECT run_id, message_id, attempt, round(latency_ms, 3) AS latency_ms, success, error_type, input_tokens FROM {attempts}")
def log_rows(spark, sf_dir):
    rows = attempt_log_rows(bind(spark, sf_dir, "attempts"))
    return rows.select("run_id", "message_id", "attempt", "latency_ms", "success", "error_type", "input_tokens")


# A log is one folder per run; few runs with many lines each keep the number of files small.
LOG_RUN = "concat('run-', m)"
LOG_LINE = """CASE WHEN k = 1 THEN 'not json' WHEN k = 2 THEN '[1]' WHEN k = 3 THEN '{"event":"other"}' WHEN k = 4 THEN '{"event":"model_call"} x'
    ELSE concat('{"event":"model_call","message_id":"', message_id, '","attempt":', CASE WHEN k = 5 THEN 'true' WHEN k = 6 THEN '"2"' WHEN attempt IS NULL THEN 'null' ELSE concat('', attempt) END,
        ',"input_tokens":', CASE WHEN k = 7 THEN '1.5' ELSE concat('', k) END, ',"success":', CASE WHEN k = 8 THEN '1' ELSE 'false' END, '}') END"""


@query(
    "attempt_log_read",
    f"SELECT {LOG_RUN} AS run_id, CASE WHEN k BETWEEN 1 AND 4 THEN 'invalid_event' ELSE '' END AS reason,"
    " CASE WHEN k NOT BETWEEN 1 AND 4 THEN message_id END AS message_id, CASE WHEN k NOT BETWEEN 1 AND 6 THEN attempt END AS attempt,"
    " CASE WHEN k NOT BETWEEN 1 AND 4 AND k <> 7 THEN k END AS input_tokens, CASE WHEN k NOT BETWEEN 1 AND 4 AND k <> 8 THEN false END AS success FROM {attempt_numbers}",
)
def log_read(spark, sf_dir):
    """Log lines written per run as text, read back as events and named bad lines."""
    lines = bind(spark, sf_dir, "attempt_numbers").selectExpr(f"{LOG_RUN} AS run_id", f"{LOG_LINE} AS value")
    path = new_folder(spark, "attempt-log")
    lines.write.partitionBy("run_id").text(path)
    events, bad = read_attempt_log(spark, path)
    columns = ("message_id", "attempt", "input_tokens", "success")
    good = events.select("run_id", F.lit("").alias("reason"), *columns)
    return good.unionByName(bad.select("run_id", "reason"), allowMissingColumns=True)


@query(
    "foreign_attempts",
    "SELECT a.run_id, a.message_id, count(*) AS events FROM {attempts} AS a LEFT JOIN {run_items} AS i ON a.run_id = i.run_id AND a.message_id = i.id WHERE i.id IS NULL GROUP BY 1, 2",
)
def foreign_attempts(spark, sf_dir):
    events, items = _events(spark, sf_dir)
    matched = A.matched_attempts(A.distinct_attempts(events), items).where(~F.col("known"))
    return matched.groupBy("run_id", "message_id").agg(F.sum("events").alias("events"))


# Row-by-row form of the accounting, as windows over the whole log.
SEEN = """a AS (SELECT e.*, i.id IS NOT NULL AS known, coalesce(e.attempt >= 1, false) AS valid,
        row_number() OVER (PARTITION BY e.run_id, e.message_id, e.attempt ORDER BY line) AS nth
        FROM {attempts} AS e LEFT JOIN {run_items} AS i ON e.run_id = i.run_id AND e.message_id = i.id),
    u AS (SELECT * FROM a WHERE known AND valid AND nth = 1),
    q AS (SELECT run_id, message_id, count(*) AS attempts, max(attempt) AS last_attempt, list_sort(list(DISTINCT attempt)) AS seen FROM u GROUP BY 1, 2),
    l AS (SELECT u.* FROM u JOIN q ON u.run_id = q.run_id AND u.message_id = q.message_id AND u.attempt = q.last_attempt)"""
CONSISTENT = """(l.success IS NOT DISTINCT FROM TRUE AND l.model IS NOT DISTINCT FROM i.meta_model AND l.prompt_version IS NOT DISTINCT FROM i.prompt_version
    AND l.input_tokens IS NOT DISTINCT FROM i.meta_input_tokens AND l.output_tokens IS NOT DISTINCT FROM i.meta_output_tokens
    AND l.cached_input_tokens IS NOT DISTINCT FROM i.meta_cached_input_tokens
    AND CAST(l.estimated_cost_usd AS DECIMAL(38, 12)) IS NOT DISTINCT FROM CAST(i.meta_estimated_cost_usd AS DECIMAL(38, 12)))"""
REASONS = f"""WITH {SEEN},
    j AS (SELECT i.*, q.attempts, q.seen, q.last_attempt FROM {{run_items}} AS i LEFT JOIN q ON q.run_id = i.run_id AND q.message_id = i.id),
    s AS (SELECT *, CASE WHEN state = 'pending' THEN CASE WHEN attempts IS NOT NULL THEN 'pending_has_attempts' ELSE '' END
            WHEN state IN ('running', 'interrupted_unknown') THEN 'unknown_outcome' WHEN attempts IS NULL THEN 'missing_attempt'
            WHEN state = 'failed' THEN 'failed_attempt_count_unknown'
            WHEN meta_attempt > max_attempts OR seen <> range(1, meta_attempt + 1) THEN 'incomplete_attempt_sequence' END AS structural FROM j),
    r AS (
        SELECT run_id, CASE WHEN known THEN message_id END AS message_id, CASE WHEN NOT known THEN 'foreign_message_event' WHEN NOT valid THEN 'invalid_attempt' ELSE 'duplicate_attempt' END AS reason
        FROM a WHERE NOT (known AND valid AND nth = 1)
        UNION ALL SELECT run_id, id, structural FROM s WHERE structural <> ''
        UNION ALL SELECT s.run_id, s.id, 'inconsistent_attempt_result' FROM s WHERE structural IS NULL AND EXISTS (
            SELECT 1 FROM u WHERE u.run_id = s.run_id AND u.message_id = s.id AND u.attempt < s.meta_attempt AND u.success IS DISTINCT FROM FALSE)
        UNION ALL SELECT i.run_id, i.id, 'inconsistent_success_metadata' FROM s AS i JOIN l ON l.run_id = i.run_id AND l.message_id = i.id WHERE structural IS NULL AND NOT {CONSISTENT}
        UNION ALL SELECT s.run_id, s.id, 'inconsistent_attempt_provenance' FROM s WHERE structural IS NULL AND EXISTS (
            SELECT 1 FROM u WHERE u.run_id = s.run_id AND u.message_id = s.id AND u.prompt_version IS DISTINCT FROM s.prompt_version))"""


@query(
    "attempt_accounting",
    REASONS + " SELECT run_id, coalesce(message_id, '') AS message_id, reason, count(*) AS occurrences FROM r GROUP BY 1, 2, 3",
)
def attempt_accounting(spark, sf_dir):
    _, reasons = A.account_usage(*_events(spark, sf_dir))
    return reasons.select("run_id", F.coalesce("message_id", F.lit("")).alias("message_id"), "reason", "occurrences")


USAGE = (
    REASONS + ", w AS (SELECT run_id, count(*) AS reasons FROM r GROUP BY run_id), o AS (SELECT DISTINCT run_id FROM {run_items}),"
    " t AS (SELECT run_id, count(*) AS observed, coalesce(sum(CASE WHEN ok THEN input_tokens END), 0) AS inputs, coalesce(sum(CASE WHEN ok THEN output_tokens END), 0) AS outputs,"
    "  round(coalesce(sum(CASE WHEN ok THEN CAST(estimated_cost_usd AS DECIMAL(38, 12)) END), 0) * 1000) AS cost_milli,"
    "  count(CASE WHEN ok AND (input_tokens IS NULL OR output_tokens IS NULL) THEN 1 END) AS no_usage, count(CASE WHEN ok AND estimated_cost_usd IS NULL THEN 1 END) AS no_cost"
    "  FROM (SELECT *, known AND valid AND nth = 1 AS ok FROM a) AS x GROUP BY run_id)"
)


def _summary(spark, sf_dir):
    summary, _ = A.account_usage(*_events(spark, sf_dir))
    return summary


@query(
    "usage_subtotals",
    USAGE + " SELECT o.run_id, CAST(coalesce(inputs, 0) AS BIGINT) AS input_tokens, CAST(coalesce(outputs, 0) AS BIGINT) AS output_tokens,"
    " CAST(coalesce(cost_milli, 0) AS BIGINT) AS cost_milli FROM o LEFT JOIN t USING (run_id)",
)
def usage_subtotals(spark, sf_dir):
    return _summary(spark, sf_dir).select(
        "run_id",
        F.col("input_tokens_known_subtotal").alias("input_tokens"),
        F.col("output_tokens_known_subtotal").alias("output_tokens"),
        (F.col("estimated_cost_usd_known_subtotal") * 1000).cast("long").alias("cost_milli"),
    )


@query(
    "usage_complete",
    USAGE + " SELECT o.run_id, coalesce(reasons, 0) = 0 AND coalesce(no_usage, 0) = 0 AS usage_complete, coalesce(reasons, 0) = 0 AND coalesce(no_cost, 0) = 0 AS cost_complete,"
    " CAST(coalesce(reasons, 0) AS BIGINT) AS reasons FROM o LEFT JOIN t USING (run_id) LEFT JOIN w USING (run_id)",
)
def usage_complete(spark, sf_dir):
    return _summary(spark, sf_dir).select(
        "run_id", "usage_complete", "cost_complete", F.col("incomplete_reasons").alias("reasons")
    )


@query("observed_calls", "SELECT run_id, count(*) AS observed_model_calls FROM {attempts} GROUP BY run_id")
def observed_calls(spark, sf_dir):
    return _summary(spark, sf_dir).select("run_id", "observed_model_calls")


@query("actual_models", "SELECT DISTINCT run_id, meta_model AS model FROM {run_items} WHERE state = 'succeeded'")
def actual_models(spark, sf_dir):
    return A.actual_models(bind(spark, sf_dir, "run_items"))


@query(
    "latency_stats",
    "SELECT run_id, min(latency_ms) AS min_latency_ms, max(latency_ms) AS max_latency_ms, round(avg(latency_ms), 6) AS mean_latency_ms FROM {attempts} GROUP BY run_id",
)
def latency_stats(spark, sf_dir):
    stats = A.latency_stats(bind(spark, sf_dir, "attempts"))
    return stats.withColumn("mean_latency_ms", F.round("mean_latency_ms", 6))


def _sequences(spark, sf_dir):
    events, items = _events(spark, sf_dir)
    return A.sequences(A.matched_attempts(A.distinct_attempts(events), items)), items


@query(
    "final_attempt_consistency",
    f"WITH {SEEN} SELECT i.run_id, i.id, meta_attempt, {CONSISTENT} AS consistent FROM {{run_items}} AS i JOIN l ON l.run_id = i.run_id AND l.message_id = i.id"
    " WHERE state = 'succeeded' AND l.attempt = meta_attempt",
)
def final_attempt_consistency(spark, sf_dir):
    return A.final_attempt_consistency(*_sequences(spark, sf_dir))


@query(
    "attempt_gaps",
    f"WITH {SEEN} SELECT run_id, message_id, attempts, last_attempt, seen = range(1, last_attempt + 1) AS gap_free FROM q",
)
def attempt_gaps(spark, sf_dir):
    return A.attempt_gaps(_sequences(spark, sf_dir)[0])


@query(
    "duplicate_attempts",
    f"WITH {SEEN} SELECT run_id, message_id, attempt, min(line) AS first_line, count(*) - 1 AS repeats FROM a WHERE known AND valid GROUP BY 1, 2, 3 HAVING count(*) > 1",
)
def duplicate_attempts(spark, sf_dir):
    """First-seen event of every repeated attempt and how often it was repeated."""
    events, items = _events(spark, sf_dir)
    matched = A.matched_attempts(A.distinct_attempts(events), items)
    repeated = matched.where(F.col("known") & A.valid_attempt() & (F.col("events") > 1))
    return repeated.select(
        "run_id", "message_id", "attempt", F.col("first.line").alias("first_line"), (F.col("events") - 1).alias("repeats")
    )


@query(
    "prior_attempts_failed",
    f"WITH {SEEN} SELECT q.run_id, q.message_id, q.last_attempt, NOT EXISTS (SELECT 1 FROM u WHERE u.run_id = q.run_id AND u.message_id = q.message_id"
    " AND u.attempt < q.last_attempt AND u.success IS DISTINCT FROM FALSE) AS prior_failed FROM q",
)
def prior_attempts_failed(spark, sf_dir):
    return A.prior_attempts_failed(_sequences(spark, sf_dir)[0])
