"""Streams over the given tables, run over what is available and read back from their output tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice import fixed_values as V
from sluice.operators import requests as R
from sluice.plans.accounting_queries import LOG_RUN
from sluice.plans.bindings import ARRIVAL, bind, stored_requests
from sluice.plans.catalog import ORACLES, query, stamp, stamp_sql
from sluice.plans.request_queries import ORDER
from sluice.sources.workspace import new_folder
from sluice.streaming.corrections import requests_table, resume_corrections
from sluice.streaming.intake import stream_intake
from sluice.streaming.usage import latest_usage, stream_usage, tail_lines


def arrive(rows: DataFrame, path: str, part: Column, parts: range):
    """Write the rows of one part after the other to a stream's folder; the stream is run after each."""
    numbered = rows.withColumn("_part", part)
    for number in parts:
        numbered.where(F.col("_part") == number).drop("_part").write.mode("append").parquet(path)
        yield number


# Three arrivals; some texts are blank, some terminal events are for IDs that nobody sent.
INTAKE_PART = "CASE WHEN l_linenumber <= 2 THEN 0 WHEN l_linenumber <= 4 THEN 1 ELSE 2 END"
INTAKE_ROWS = (
    f"SELECT id, CASE WHEN l_suppkey % 13 = 0 THEN ' ' ELSE raw_message END AS raw_message, {ORDER}, CAST(NULL AS VARCHAR(20)) AS target, CAST(NULL AS VARCHAR(20)) AS failure_code FROM {{submissions}}"
    f" UNION ALL SELECT CASE WHEN l_partkey % 11 = 0 THEN concat('x-', id) ELSE id END, CAST(NULL AS VARCHAR(20)), {ORDER}, target, failure_code FROM {{terminal_events}} WHERE l_partkey % 3 = 0"
)


@query(
    "stream_intake",
    f"WITH s AS (SELECT *, {INTAKE_PART} AS part FROM ({INTAKE_ROWS})),"
    f" v AS (SELECT *, row_number() OVER w AS rn, first_value(raw_message) OVER w AS owner, first_value(part) OVER w AS born FROM s WHERE raw_message <> ' ' WINDOW w AS (PARTITION BY id ORDER BY {ORDER}, raw_message)),"
    " o AS (SELECT id, owner, born FROM v WHERE rn = 1),"
    f" t AS (SELECT s.*, born, row_number() OVER (PARTITION BY s.id, coalesce(born <= part, false) ORDER BY {ORDER}, target, failure_code) AS rn FROM s LEFT JOIN o ON s.id = o.id WHERE target IS NOT NULL),"
    " e AS (SELECT id, target AS reached, part AS ended FROM t WHERE born <= part AND rn = 1)"
    f" SELECT id, raw_message, l_linenumber, l_partkey, l_suppkey, l_extendedprice, {stamp_sql('l_shipdate')} AS arrived, target,"
    " CASE WHEN born <= part AND rn = 1 THEN 'applied' WHEN born <= part THEN 'not_processing' ELSE 'not_found' END AS outcome FROM t"
    f" UNION ALL SELECT v.id, raw_message, l_linenumber, l_partkey, l_suppkey, l_extendedprice, {stamp_sql('l_shipdate')}, target,"
    " CASE WHEN raw_message <> owner THEN 'conflict' WHEN part > born THEN CASE WHEN ended IS NULL OR ended >= part THEN 'in_progress'"
    " WHEN reached = 'completed' THEN 'duplicate_completed' ELSE 'failed_terminal' END WHEN rn = 1 THEN 'created' ELSE 'duplicate' END FROM v LEFT JOIN e ON v.id = e.id"
    f" UNION ALL SELECT id, raw_message, l_linenumber, l_partkey, l_suppkey, l_extendedprice, {stamp_sql('l_shipdate')}, target, 'invalid' FROM s WHERE raw_message = ' '",
)
def intake(spark, sf_dir):
    """Submissions and terminal events in three arrivals; state is kept from one to the next."""
    inputs = {name: bind(spark, sf_dir, name) for name in ("submissions", "terminal_events")}
    rows = spark.sql(INTAKE_ROWS, **inputs).withColumns({name: F.col(name).cast("string") for name in ("id", "raw_message", "target", "failure_code")})
    base = new_folder(spark, "stream-intake")
    for _ in arrive(rows, f"{base}/source", F.expr(INTAKE_PART), range(3)):
        stream_intake(spark.readStream.schema(rows.schema).parquet(f"{base}/source"), base, list(ARRIVAL)).awaitTermination()
    return spark.read.parquet(f"{base}/outcomes").select(
        "id", "raw_message", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", stamp(F.col("l_shipdate")).alias("arrived"), "target", "outcome"
    )


def _stream_corrections(spark, sf_dir):
    """Three arrivals in the order of their times, folded one after the other into a bucketed table."""
    changes = bind(spark, sf_dir, "corrections")
    bounds = changes.select(F.col("ts").cast("timestamp").cast("double").alias("t")).approxQuantile("t", [0.33, 0.66], 0.05)
    moment = F.col("ts").cast("timestamp").cast("double")
    part = sum((F.when(moment > bound, 1).otherwise(0) for bound in bounds), F.lit(0))
    base = new_folder(spark, "stream-corrections")
    requests = stored_requests(bind(spark, sf_dir, "requests"))
    paths = (f"{base}/requests", f"{base}/rejected", f"{base}/checkpoint")
    requests_table(spark, paths[0]).create(requests, 16)
    for _ in arrive(changes, f"{base}/source", part, range(3)):
        resume_corrections(spark.readStream.schema(changes.schema).parquet(f"{base}/source"), *paths, most_deltas=1).awaitTermination()
    return paths


@query("stream_corrections")
def corrections(spark, sf_dir):
    latest = requests_table(spark, _stream_corrections(spark, sf_dir)[0]).read()
    return latest.select(
        "id", "state", R.effective_classification().alias("e"), F.col("human_correction").isNotNull().alias("corrected")
    ).select("id", "state", *[f"e.{name}" for name in V.CONTENT_FIELDS], "corrected")


@query("stream_correction_rejects")
def correction_rejects(spark, sf_dir):
    return spark.read.parquet(_stream_corrections(spark, sf_dir)[1]).select("id", "seq", "reason")


USAGE_LINE = """CASE WHEN k = 1 THEN 'not json' WHEN k = 2 THEN '[1]'
    ELSE concat('{"event":"model_call","message_id":"', message_id, '","input_tokens":', CASE WHEN k % 7 = 3 THEN 'null' ELSE concat('', k) END,
        ',"output_tokens":', CASE WHEN k % 5 = 3 THEN '"9"' ELSE concat('', k * 2) END, ',"estimated_cost_usd":', CASE WHEN k % 4 = 3 THEN 'null' ELSE '0.25' END, '}') END"""


@query(
    "stream_usage",
    f"SELECT {LOG_RUN} AS run_id, count(CASE WHEN k > 2 THEN 1 END) AS observed_model_calls, count(CASE WHEN k <= 2 THEN 1 END) AS invalid_lines,"
    " CAST(coalesce(sum(CASE WHEN k > 2 AND k % 7 <> 3 THEN k END), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(CASE WHEN k > 2 AND k % 5 <> 3 THEN k * 2 END), 0) AS BIGINT) AS output_tokens,"
    " CAST(count(CASE WHEN k > 2 AND k % 4 <> 3 THEN 1 END) AS DOUBLE) / 4 AS cost_usd FROM {attempt_numbers} WHERE k > 0 GROUP BY 1",
)
def usage(spark, sf_dir):
    """Logs that grow three times; totals of the runs that grew are written, and the last ones read back."""
    base = new_folder(spark, "stream-usage")
    rows = bind(spark, sf_dir, "attempt_numbers").where("k > 0")
    for part in range(3):
        # The last part holds lines of some runs only.
        lines = rows.where(F.when(F.col("m") < 4, F.col("line") % 3).otherwise(F.col("line") % 2) == part)
        lines.selectExpr(f"{LOG_RUN} AS run_id", f"{USAGE_LINE} AS value").write.mode("append").partitionBy("run_id").text(f"{base}/log")
        stream_usage(tail_lines(spark, f"{base}/log"), f"{base}/totals", f"{base}/checkpoint").awaitTermination()
    return latest_usage(spark, f"{base}/totals").select(
        "run_id", "observed_model_calls", "invalid_lines", F.col("input_tokens_known_subtotal").alias("input_tokens"),
        F.col("output_tokens_known_subtotal").alias("output_tokens"), F.col("estimated_cost_usd_known_subtotal").cast("double").alias("cost_usd"),
    )


# Corrections that arrive in the order of their times end where the batch form does, with the same rejects.
ORACLES["stream_corrections"] = ORACLES["correction_fold"]
ORACLES["stream_correction_rejects"] = ORACLES["correction_rejects"]
