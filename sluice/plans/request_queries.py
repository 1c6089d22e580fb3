"""Stored requests: projections, listing, intake, lifecycle, corrections."""

from datetime import datetime

from pyspark.sql import functions as F

from sluice import fixed_values as V
from sluice.operators import corrections as K
from sluice.operators import requests as R
from sluice.operators.language import policy_scope
from sluice.plans.bindings import ARRIVAL, bind, bind_spread, stored_requests
from sluice.plans.catalog import query, stamp, stamp_sql
from sluice import schemas
from sluice.sources.buckets import BucketTable
from sluice.sources.store import decode_text_rows, encode_json, guard_finished, requests_scan, upsert_bucketed, write_version
from sluice.sources.workspace import new_folder

ORDER = ", ".join(ARRIVAL)
FLAT = ("id", "state", "effective_category", "effective_priority", "effective_area")
DONE = "CASE WHEN state = 'completed' THEN {} END"
FLAT_SQL = (
    "id, state, CASE WHEN state = 'completed' THEN categoria END AS effective_category,"
    " CASE WHEN state = 'completed' THEN prioridad END AS effective_priority,"
    " CASE WHEN state = 'completed' THEN area_sugerida END AS effective_area"
)
EFFECTIVE_SQL = ", ".join(f"{DONE.format(name)} AS {name}" for name in V.CONTENT_FIELDS)


def stored(spark, sf_dir):
    return stored_requests(bind(spark, sf_dir, "requests"))


@query(
    "requests_scan",
    f"SELECT {FLAT_SQL}, {EFFECTIVE_SQL}, {DONE.format('confianza')} AS confianza, {DONE.format('key_number')} AS input_tokens,"
    f" {stamp_sql('created_at')} AS created FROM {{requests}}",
)
def scan(spark, sf_dir):
    """A written table version read back: text rows decoded, nested columns native."""
    rows = stored(spark, sf_dir)
    as_text = rows.select(
        "*",
        encode_json(F.col("ai_classification")).alias("ai_classification_json"),
        encode_json(F.col("human_correction")).alias("human_correction_json"),
        encode_json(F.col("provider_metadata")).alias("provider_metadata_json"),
    ).drop("ai_classification", "human_correction", "provider_metadata")
    path = new_folder(spark, "requests")
    write_version(decode_text_rows(as_text), path)
    return requests_scan(spark, path).select(
        *FLAT, *[f"ai_classification.{name}" for name in V.CONTENT_FIELDS], "ai_classification.confianza",
        "provider_metadata.input_tokens", stamp(F.col("created_at")).alias("created"),
    )


@query("effective_classification", f"SELECT id, {EFFECTIVE_SQL} FROM {{requests}}")
def effective(spark, sf_dir):
    rows = stored(spark, sf_dir).select("id", R.effective_classification().alias("e"))
    return rows.select("id", "e.*")


@query("request_summary", f"SELECT id, state, {EFFECTIVE_SQL}, {DONE.format('1')} AS attempt, {stamp_sql('created_at')} AS created FROM {{requests}}")
def summary(spark, sf_dir):
    return R.request_summary(stored(spark, sf_dir)).select(
        "id", "state", "effective_classification.*", "provider_metadata.attempt", stamp(F.col("created_at")).alias("created")
    )


@query("request_detail", f"SELECT id, state, raw_message AS mensaje, {DONE.format('confianza')} AS confianza FROM {{requests}}")
def detail(spark, sf_dir):
    return R.request_detail(stored(spark, sf_dir)).select("id", "state", "mensaje", "ai_classification.confianza")


@query("in_progress", f"SELECT id, state, {stamp_sql('created_at')} AS created FROM {{requests}} WHERE state = 'processing'")
def processing(spark, sf_dir):
    return R.in_progress(stored(spark, sf_dir)).select("id", "state", stamp(F.col("created_at")).alias("created"))


@query(
    "list_filter",
    f"SELECT {FLAT_SQL} FROM {{requests}} WHERE state = 'completed' AND categoria = 'datos' AND prioridad = 'alta' AND area_sugerida = 'data'",
)
def filtered(spark, sf_dir):
    return R.completed_matching(stored(spark, sf_dir), "datos", "alta", "data").select(*FLAT)


@query("lookup_ids", f"SELECT {FLAT_SQL} FROM {{requests}} WHERE id IN (SELECT concat('r-', c_custkey) FROM {{customer}})")
def lookup_ids(spark, sf_dir):
    wanted = bind(spark, sf_dir, "customer").select(F.concat(F.lit("r-"), "c_custkey").alias("id"))
    return R.lookup(stored(spark, sf_dir), wanted).select(*FLAT)


@query(
    "list_page",
    f"SELECT {FLAT_SQL}, {stamp_sql('created_at')} AS created FROM {{requests}} WHERE state = 'completed' AND prioridad = 'alta'"
    " ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 40",
)
def page(spark, sf_dir):
    return R.list_requests(stored(spark, sf_dir), priority="alta", limit=20, offset=40).select(
        *FLAT, stamp(F.col("created_at")).alias("created")
    )


@query(
    "list_page_keyset",
    f"SELECT {FLAT_SQL}, {stamp_sql('created_at')} AS created FROM {{requests}} WHERE state = 'completed'"
    " AND (created_at, id) < (TIMESTAMP '1998-06-01 00:00:00', 'r-5') ORDER BY created_at DESC, id DESC LIMIT 20",
)
def page_after(spark, sf_dir):
    return R.list_after(stored(spark, sf_dir), datetime(1998, 6, 1), "r-5").select(
        *FLAT, stamp(F.col("created_at")).alias("created")
    )


OWNED_SQL = (
    f"SELECT *, row_number() OVER w AS rn, first_value(raw_message) OVER w AS owner FROM {{submissions}}"
    f" WINDOW w AS (PARTITION BY id ORDER BY {ORDER}, raw_message)"
)
FIRST_SQL = f"SELECT *, row_number() OVER (PARTITION BY id ORDER BY {ORDER}, raw_message) AS rn FROM {{submissions}}"


@query("first_writer", f"SELECT id, raw_message AS first_message, n AS submissions FROM ({FIRST_SQL}) JOIN (SELECT id, count(*) AS n FROM {{submissions}} GROUP BY id) USING (id) WHERE rn = 1")
def first_writer(spark, sf_dir):
    firsts = R.first_writer(bind(spark, sf_dir, "submissions"), list(ARRIVAL))
    return firsts.select("id", "first_message", F.col("_rows").alias("submissions"))


@query(
    "intake_outcomes",
    f"WITH f AS ({OWNED_SQL})"
    f" SELECT id, raw_message, l_linenumber, l_partkey, l_suppkey, l_extendedprice, {stamp_sql('l_shipdate')} AS arrived,"
    " CASE WHEN raw_message <> owner THEN 'conflict' WHEN rn = 1 THEN 'created' ELSE 'duplicate' END AS outcome FROM f",
)
def intake_outcomes(spark, sf_dir):
    return R.intake(bind(spark, sf_dir, "submissions"), list(ARRIVAL)).select(
        "id", "raw_message", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        stamp(F.col("l_shipdate")).alias("arrived"), "outcome",
    )


STORED_SQL = (
    "SELECT id, state, CASE key_number % 3 WHEN 0 THEN 'AF' WHEN 1 THEN 'NO' ELSE 'RF' END AS raw_message FROM {requests}"
    " WHERE created_at < TIMESTAMP '2000-01-01 00:00:00'"
)


@query(
    "intake_route",
    f"WITH f AS ({OWNED_SQL}), s AS (SELECT id, state, raw_message AS stored_message FROM ({STORED_SQL}))"
    " SELECT f.id, raw_message, l_linenumber, l_partkey, l_suppkey, l_extendedprice,"
    " CASE WHEN raw_message <> coalesce(stored_message, owner) THEN 'conflict' WHEN state = 'completed' THEN 'duplicate_completed'"
    " WHEN state = 'processing' THEN 'in_progress' WHEN state = 'failed' THEN 'failed_terminal'"
    " WHEN rn = 1 THEN 'created' ELSE 'duplicate' END AS outcome FROM f LEFT JOIN s ON f.id = s.id",
)
def intake_route(spark, sf_dir):
    known = spark.sql(STORED_SQL, requests=bind(spark, sf_dir, "requests"))
    return R.intake(bind(spark, sf_dir, "submissions"), list(ARRIVAL), known).select(
        "id", "raw_message", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "outcome"
    )


TERMINAL_SQL = f"SELECT *, row_number() OVER (PARTITION BY id ORDER BY {ORDER}, target, failure_code) AS rn FROM {{terminal_events}}"


@query(
    "lifecycle",
    f"WITH t AS ({TERMINAL_SQL}) SELECT 'request' AS kind, r.id, CASE WHEN state = 'processing' AND target IS NOT NULL THEN target ELSE state END AS result,"
    " CASE WHEN state = 'processing' THEN t.failure_code END AS code, CAST(0 AS DOUBLE) AS price"
    " FROM {requests} AS r LEFT JOIN t ON r.id = t.id AND rn = 1"
    " UNION ALL SELECT 'event', t.id, CASE WHEN state IS NULL THEN 'not_found' WHEN state <> 'processing' THEN 'not_processing'"
    " WHEN rn = 1 THEN 'applied' ELSE 'not_processing' END, t.failure_code, l_extendedprice"
    " FROM t LEFT JOIN {requests} AS r ON r.id = t.id",
)
def lifecycle(spark, sf_dir):
    """New state of every request, and the verdict on every terminal event."""
    requests, events = bind(spark, sf_dir, "requests"), bind(spark, sf_dir, "terminal_events")
    moved, routed = R.lifecycle(requests, events, list(ARRIVAL))
    left = moved.select(
        F.lit("request").alias("kind"), "id", F.col("state").alias("result"), F.col("new_failure_code").alias("code"),
        F.lit(0.0).alias("price"),
    )
    right = routed.select(
        F.lit("event").alias("kind"), "id", F.col("verdict").alias("result"), F.col("failure_code").alias("code"),
        F.col("l_extendedprice").alias("price"),
    )
    return left.unionByName(right)


@query(
    "request_times",
    "WITH c AS (SELECT concat('r-', l_orderkey) AS id, min(l_shipdate) AS created FROM {lineitem} GROUP BY 1),"
    " e AS (SELECT concat('r-', o_orderkey) AS id, min(o_orderdate) AS classified FROM {orders} WHERE o_orderstatus = 'F' GROUP BY 1),"
    " k AS (SELECT id, max(ts) AS corrected FROM {corrections} GROUP BY 1)"
    f" SELECT id, {stamp_sql('created')} AS created, {stamp_sql('classified')} AS classified, {stamp_sql('corrected')} AS corrected,"
    f" {stamp_sql('coalesce(corrected, classified, created)')} AS updated FROM c LEFT JOIN e USING (id) LEFT JOIN k USING (id)",
)
def request_times(spark, sf_dir):
    submissions = bind(spark, sf_dir, "submissions").withColumnRenamed("l_shipdate", "arrival")
    done = bind(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F")
    events = done.select(F.concat(F.lit("r-"), "o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"))
    times = R.request_times(submissions, events, bind(spark, sf_dir, "corrections"))
    return times.select(
        "id", *[stamp(F.col(f"{name}_at")).alias(name) for name in ("created", "classified", "corrected", "updated")]
    )


@query(
    "requests_upsert",
    f"WITH t AS ({TERMINAL_SQL}), f AS ({FIRST_SQL}),"
    " s AS (SELECT id, state, categoria, prioridad, failure_code, raw_message FROM {requests} WHERE created_at < TIMESTAMP '2000-01-01 00:00:00'),"
    " a AS (SELECT id, state, CASE WHEN state = 'completed' THEN categoria END AS category, failure_code, raw_message FROM s"
    "  UNION ALL SELECT id, 'processing', NULL, NULL, raw_message FROM f WHERE rn = 1 AND id NOT IN (SELECT id FROM s)),"
    " j AS (SELECT a.*, t.target, t.failure_code AS new_code, r.categoria FROM a LEFT JOIN t ON a.id = t.id AND rn = 1 LEFT JOIN {requests} AS r ON r.id = a.id)"
    " SELECT id, raw_message, CASE WHEN state = 'processing' AND target IS NOT NULL THEN CASE WHEN target = 'completed' AND categoria IS NOT NULL THEN 'completed' ELSE 'failed' END ELSE state END AS state,"
    " CASE WHEN state = 'processing' AND target = 'completed' THEN categoria ELSE category END AS category,"
    " CASE WHEN state = 'processing' AND target IS NOT NULL AND NOT (target = 'completed' AND categoria IS NOT NULL) THEN coalesce(new_code, 'unexpected_error') ELSE failure_code END AS code FROM j",
)
def requests_upsert(spark, sf_dir):
    """Reservations, then first terminal events, each as a delta of a bucketed table; compacted, and read back."""
    early = bind(spark, sf_dir, "requests").where(F.col("created_at") < F.lit("2000-01-01").cast("timestamp_ntz"))
    firsts = R.first_writer(bind(spark, sf_dir, "submissions"), list(ARRIVAL))
    reserved = firsts.select(
        "id", F.col("first_message").alias("raw_message"), F.col("_first.l_shipdate").cast("timestamp").alias("arrival")
    )
    ends = R.first_terminal(bind(spark, sf_dir, "terminal_events"), list(ARRIVAL))
    labels = stored_requests(bind(spark, sf_dir, "requests").withColumn("state", F.lit("completed")))
    labels = labels.select("id", F.col("ai_classification").alias("classification"), F.col("provider_metadata").alias("metadata"))
    finished = ends.join(labels, "id", "left").withColumn("good", F.col("_first.target") == "completed")
    finished = finished.select(
        "id", F.col("_first.l_shipdate").cast("timestamp").alias("at"),
        F.when(F.col("good"), F.col("classification")).alias("classification"),
        F.when(F.col("good"), F.col("metadata")).alias("metadata"),
        F.coalesce("_first.failure_code", F.lit("unexpected_error")).alias("error_type"),
    )
    table = BucketTable(spark, new_folder(spark, "upsert"), schemas.REQUEST)
    version = upsert_bucketed(table, table.create(stored_requests(early), 16), reserved, finished.limit(0))
    version = table.compact(upsert_bucketed(table, version, reserved.limit(0), guard_finished(finished)[0]), 1)
    return table.read(version).select(
        "id", "raw_message", "state", F.col("effective_category").alias("category"), F.col("failure_code").alias("code")
    )


@query(
    "upsert_rejects",
    "SELECT row_id AS id, CASE WHEN state = 'completed' THEN 'other_id' ELSE 'failure_code' END AS reason FROM"
    " (SELECT r.id AS row_id, state, key_number, priority_text, n FROM {requests} AS r JOIN (SELECT id, count(*) AS n FROM {requests} GROUP BY id) AS c ON c.id = r.id) WHERE"
    " (state = 'completed' AND key_number % 7 = 0) OR (state = 'failed' AND priority_text <> '1-URGENT')",
)
def upsert_rejects(spark, sf_dir):
    """Classifications under another ID and failure codes that are no codes, kept out of the table."""
    rows = stored(spark, sf_dir).join(bind(spark, sf_dir, "requests").select("id", "key_number", "priority_text"), "id")
    other = F.col("ai_classification").withField("id", F.when(F.col("key_number") % 7 == 0, F.lit("other")).otherwise(F.col("id")))
    finished = rows.where(F.col("state") != "processing").select(
        "id", F.col("created_at").alias("at"), F.when(F.col("state") == "completed", other).alias("classification"),
        F.col("provider_metadata").alias("metadata"),
        F.when(F.col("priority_text") == "1-URGENT", "timeout").when(F.col("priority_text") == "5-LOW", F.lit(None)).otherwise(F.col("priority_text")).alias("error_type"),
    )
    return guard_finished(finished)[1].select("id", "reason")


# Sequential brute force over each ID's corrections.
FOLD_CTES = """c AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts, seq) AS n FROM {corrections}),
    fold AS (
        SELECT id, CAST(0 AS BIGINT) AS n, state, categoria, prioridad, area_sugerida, idioma, resumen, requiere_info, pregunta_seguimiento,
               CAST(0 AS BIGINT) AS seq, CAST('' AS VARCHAR) AS reason, CAST(0 AS BIGINT) AS accepted FROM {requests}
        UNION ALL
        SELECT id, n, state,
               CASE WHEN reason = '' AND has_categoria THEN n_categoria ELSE categoria END,
               CASE WHEN reason = '' AND has_prioridad THEN n_prioridad ELSE prioridad END,
               CASE WHEN reason = '' AND has_area_sugerida THEN n_area ELSE area_sugerida END,
               CASE WHEN reason = '' AND has_idioma THEN n_idioma ELSE idioma END,
               CASE WHEN reason = '' AND has_resumen THEN n_resumen ELSE resumen END,
               CASE WHEN reason = '' AND has_requiere_info THEN n_needs ELSE requiere_info END,
               CASE WHEN reason = '' AND has_pregunta_seguimiento THEN n_question ELSE pregunta_seguimiento END,
               seq, reason, accepted + CASE WHEN reason = '' THEN 1 ELSE 0 END
        FROM (SELECT fold.*  EXCLUDE (n, seq, reason), c.n, c.seq,
                     c.has_categoria, c.has_prioridad, c.has_area_sugerida, c.has_idioma, c.has_resumen, c.has_requiere_info, c.has_pregunta_seguimiento,
                     c.categoria AS n_categoria, c.prioridad AS n_prioridad, c.area_sugerida AS n_area, c.idioma AS n_idioma,
                     c.resumen AS n_resumen, c.requiere_info AS n_needs, c.pregunta_seguimiento AS n_question,
                     CASE WHEN NOT (c.has_categoria OR c.has_prioridad OR c.has_area_sugerida OR c.has_idioma OR c.has_resumen OR c.has_requiere_info OR c.has_pregunta_seguimiento) THEN 'empty'
                          WHEN fold.state <> 'completed' THEN 'not_completed'
                          WHEN c.has_categoria AND c.categoria = 'urgente' THEN 'invalid_label'
                          WHEN c.has_resumen AND c.resumen = '' THEN 'summary_words'
                          WHEN c.has_pregunta_seguimiento AND regexp_full_match(c.pregunta_seguimiento, '\\s*') THEN 'follow_up'
                          WHEN (CASE WHEN c.has_requiere_info THEN c.requiere_info ELSE fold.requiere_info END)
                               <> ((CASE WHEN c.has_pregunta_seguimiento THEN c.pregunta_seguimiento ELSE fold.pregunta_seguimiento END) IS NOT NULL) THEN 'follow_up'
                          ELSE '' END AS reason
              FROM fold JOIN c ON c.id = fold.id AND c.n = fold.n + 1) AS s)"""
LAST_SQL = "SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC) AS back FROM fold"


@query(
    "correction_fold",
    f"WITH RECURSIVE {FOLD_CTES} SELECT id, state, {EFFECTIVE_SQL}, accepted > 0 AS corrected FROM ({LAST_SQL}) WHERE back = 1",
)
def correction_fold(spark, sf_dir):
    folded, _ = K.fold_corrections(stored(spark, sf_dir), bind_spread(spark, sf_dir, "corrections"))
    rows = folded.select(
        "id", "state", R.effective_classification().alias("e"), F.col("human_correction").isNotNull().alias("corrected")
    )
    return rows.select("id", "state", "e.*", "corrected")


@query(
    "correction_rejects",
    f"WITH RECURSIVE {FOLD_CTES} SELECT id, seq, reason FROM fold WHERE n > 0 AND reason <> ''",
)
def correction_rejects(spark, sf_dir):
    _, rejected = K.fold_corrections(stored(spark, sf_dir), bind_spread(spark, sf_dir, "corrections"))
    return rejected.select("id", "seq", "reason")


@query(
    "effective_columns",
    f"WITH RECURSIVE {FOLD_CTES} SELECT id, state, {DONE.format('categoria')} AS effective_category,"
    f" {DONE.format('prioridad')} AS effective_priority, {DONE.format('area_sugerida')} AS effective_area FROM ({LAST_SQL}) WHERE back = 1",
)
def effective_columns(spark, sf_dir):
    folded, _ = K.fold_corrections(stored(spark, sf_dir), bind_spread(spark, sf_dir, "corrections"))
    return folded.select(*FLAT)


@query(
    "latest_correction",
    "SELECT id, " + ", ".join(
        f"arg_max({name}, (ts, seq)) FILTER (has_{name} AND {name} IS NOT NULL) AS {name}" for name in ("categoria", "prioridad", "resumen")
    ) + ", count(*) AS corrections FROM {corrections} GROUP BY id",
)
def latest_correction(spark, sf_dir):
    """The last given value of each field per ID, whatever was valid."""
    rows = bind(spark, sf_dir, "corrections").withColumn("reason", F.lit(None).cast("string"))
    latest = K.latest_fields(rows)
    return latest.select(
        "id", *[F.col(f"_{name}.{name}").alias(name) for name in ("categoria", "prioridad", "resumen")],
        F.col("_accepted").alias("corrections"),
    )


@query(
    "policy_scope",
    "SELECT id, seq, has_resumen AS changed, CASE WHEN has_resumen THEN length(resumen) > 0 ELSE true END AS ok FROM {corrections}",
)
def scoped(spark, sf_dir):
    rows = bind(spark, sf_dir, "corrections").withColumn("summary_accepted", F.length("resumen") > 0)
    return policy_scope(rows, "has_resumen").select("id", "seq", F.col("has_resumen").alias("changed"), F.col("policy_ok").alias("ok"))
