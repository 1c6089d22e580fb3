"""Fingerprints of given tables, and runs of which some may be resumed, scored and compared and others not."""

from pyspark.sql import functions as F

from sluice.operators import fingerprints as P
from sluice.operators import guards as G
from sluice.operators.pairing import candidate_pairs
from sluice.plans.bindings import bind, bind_spread
from sluice.plans.catalog import flags_sql, listed, query

# A document as one line of text, in both engines.
LINE = "concat(doc_id, '|', lang, '|', n_chars, '|', text)"


def digest_sql(row: str) -> str:
    """The fingerprint in plain SQL, for use beside a GROUP BY."""
    sums = ", '-', ".join(f"CAST(coalesce(sum(CAST(concat('0x', substr(sha256({row}), {16 * k + 1}, 15)) AS HUGEINT)), 0) AS VARCHAR)" for k in range(4))
    return f"sha256(concat(CAST(count(*) AS VARCHAR), '-', {sums}))"


@query("table_digest", f"SELECT source AS name, count(*) AS rows, {digest_sql(LINE)} AS sha256 FROM {{documents}} GROUP BY source")
def table_digest(spark, sf_dir):
    """Documents by source, from partial digests of every language that are merged."""
    parts = P.partial_digest(bind_spread(spark, sf_dir, "documents").withColumnRenamed("source", "name"), ("name", "lang"), F.expr(LINE))
    return P.finish_digest(P.merge_digests(parts, ("name",)))


@query(
    "ordered_digest",
    f"SELECT count(*) AS rows, {digest_sql(f'concat(position, chr(58), {LINE})')} AS sha256 FROM (SELECT *, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS position FROM {{documents}}) AS p",
)
def ordered_digest(spark, sf_dir):
    """Documents in the order of their length: the fingerprint of the sequence."""
    rows = bind_spread(spark, sf_dir, "documents").withColumn("_down", -F.col("n_chars"))
    return P.table_digest(P.with_positions(rows, ["_down", "doc_id"]), row=F.expr(LINE), position="position")


# Sources as they were recorded: one lost a row, one has a row twice, one a changed text, one did not exist.
DRIFTED = "CASE name WHEN 'src1' THEN 'changed' WHEN 'src2' THEN 'changed' WHEN 'src3' THEN 'changed' WHEN 'src4' THEN 'new' ELSE 'same' END"


@query("input_drift", f"SELECT name, {DRIFTED} AS drift FROM (SELECT DISTINCT source AS name FROM {{documents}}) AS n UNION ALL SELECT 'srcx', 'gone'")
def input_drift(spark, sf_dir):
    docs = bind_spread(spark, sf_dir, "documents").withColumnRenamed("source", "name")
    least = docs.groupBy("name").agg(F.min("doc_id").alias("_least"))
    marked = docs.join(least, "name").withColumn("_first", F.col("doc_id") == F.col("_least"))
    recorded = marked.where(~(F.col("_first") & (F.col("name") == "src1")) & (F.col("name") != "src4"))
    twice = recorded.where(F.col("_first") & (F.col("name") == "src2"))
    revised = F.when(F.col("_first") & (F.col("name") == "src3"), F.concat("text", F.lit("."))).otherwise(F.col("text"))
    gone = marked.where(F.col("_first") & (F.col("name") == "src5")).withColumn("name", F.lit("srcx"))
    recorded = recorded.unionByName(twice).unionByName(gone).withColumn("text", revised)
    line = F.expr(LINE)
    return P.table_drift(P.table_digest(recorded, ("name",), line), P.table_digest(docs, ("name",), line))


PLANNED_SQL = "SELECT concat('trial-', key_number % 40) AS run_id, count(*) AS expected_ids FROM {requests} GROUP BY 1"
DONE_SQL = (
    f"e AS ({PLANNED_SQL}), d AS (SELECT run_id, count(*) AS items, count(DISTINCT id) AS ids, bool_and(state = 'succeeded') AS ok,"
    " count(DISTINCT CASE WHEN state = 'succeeded' THEN model END) AS models, min(CASE WHEN state = 'succeeded' THEN model END) AS model,"
    " count(DISTINCT CASE WHEN state = 'succeeded' THEN version_prompt END) AS versions FROM {trial_results} GROUP BY run_id),"
    " h AS (SELECT t.*, items, expected_ids, ids = expected_ids AND ok AS complete, models, model, versions = 1 AS provenance_ok FROM {trial_headers} AS t JOIN d USING (run_id) JOIN e USING (run_id))"
)


def _trials(spark, sf_dir):
    """Run headers with what their results say about them."""
    results = bind(spark, sf_dir, "trial_results")
    planned = spark.sql(PLANNED_SQL, requests=bind(spark, sf_dir, "requests"))
    complete = G.run_complete(results, planned).select("run_id", "complete")
    single = G.single_version(results).select("run_id", "models", (F.col("versions") == 1).alias("provenance_ok"))
    model = results.where("state = 'succeeded'").groupBy("run_id").agg(F.min("model").alias("model"))
    runs = bind(spark, sf_dir, "trial_headers").join(complete, "run_id").join(single, "run_id", "left").join(model, "run_id", "left")
    return runs.fillna({"models": 0, "provenance_ok": False})


@query("trial_complete", f"WITH {DONE_SQL} SELECT run_id, expected_ids, ids AS distinct_ids, ids = expected_ids AND ok AS complete FROM e JOIN d USING (run_id)")
def trial_complete(spark, sf_dir):
    planned = spark.sql(PLANNED_SQL, requests=bind(spark, sf_dir, "requests"))
    return G.run_complete(bind(spark, sf_dir, "trial_results"), planned)


@query(
    "trial_comparability",
    f"WITH {DONE_SQL} SELECT b.run_id AS baseline, concat('trial-', b.run_number + 1) AS candidate, " + flags_sql([
        ("unknown_run", "c.run_id IS NULL"),
        ("same_prompt_version", "b.prompt_version = c.prompt_version"),
        ("same_prompt_text", "b.prompt_sha256 = c.prompt_sha256"),
        ("fixtures_differ", "b.messages_sha256 <> c.messages_sha256"),
        ("settings_differ", "b.execution <> c.execution"),
        ("incomplete", "c.run_id IS NOT NULL AND NOT (b.complete AND c.complete)"),
        ("provenance", "c.run_id IS NOT NULL AND NOT (b.provenance_ok AND c.provenance_ok)"),
        ("models_differ", "c.run_id IS NOT NULL AND NOT (b.models = 1 AND c.models = 1 AND b.model = c.model)"),
    ]) + " AS reasons FROM h AS b LEFT JOIN h AS c ON c.run_number = b.run_number + 1",
)
def trial_comparability(spark, sf_dir):
    """Every trial against the next one: some can be compared, the others for every kind of reason not."""
    runs = _trials(spark, sf_dir)
    pairs = runs.select(F.col("run_id").alias("baseline"), F.concat(F.lit("trial-"), F.col("run_number") + 1).alias("candidate"))
    wanted = ("run_id", "prompt_version", "prompt_sha256", "messages_sha256", "references_sha256", "execution", "complete", "provenance_ok", "models", "model")
    return G.comparability(pairs, runs.select(*wanted)).select("baseline", "candidate", listed(F.col("reasons")).alias("reasons"))


FIT_SQL = "complete AND provenance_ok AND models = 1"
VERSIONS_SQL = (
    f"{DONE_SQL}, f AS (SELECT *, concat(messages_sha256, references_sha256, execution, model) AS block FROM h WHERE {FIT_SQL}),"
    " g AS (SELECT block, prompt_version, min(created_at) AS since, arg_max(run_id, created_at) AS stands, arg_max(prompt_sha256, created_at) AS sha FROM f GROUP BY ALL),"
    " o AS (SELECT *, lag(stands) OVER w AS baseline, lag(sha) OVER w AS before_sha, lead(sha) OVER w AS after_sha FROM g WINDOW w AS (PARTITION BY block ORDER BY since, prompt_version))"
)


@query("trial_pairs", f"WITH {VERSIONS_SQL} SELECT baseline, stands AS candidate FROM o WHERE baseline IS NOT NULL AND before_sha <> sha")
def trial_pairs(spark, sf_dir):
    return candidate_pairs(_trials(spark, sf_dir))[0].select("baseline", "candidate")


@query(
    "trial_unpaired",
    f"WITH {VERSIONS_SQL} SELECT run_id, " + flags_sql([("incomplete", "NOT complete"), ("provenance", "NOT provenance_ok"), ("models_differ", "models <> 1")]) + f" AS reasons FROM h WHERE NOT ({FIT_SQL})"
    " UNION ALL SELECT run_id, CASE WHEN run_id <> stands THEN 'superseded' WHEN before_sha IS NULL AND after_sha IS NULL THEN 'alone' ELSE 'same_prompt_text' END"
    " FROM f JOIN o ON f.block = o.block AND f.prompt_version = o.prompt_version"
    " WHERE run_id <> stands OR NOT (coalesce(before_sha <> sha, false) OR coalesce(after_sha <> sha, false))",
)
def trial_unpaired(spark, sf_dir):
    return candidate_pairs(_trials(spark, sf_dir))[1].select("run_id", listed(F.col("reasons")).alias("reasons"))


@query(
    "trial_resume",
    f"WITH {DONE_SQL} SELECT run_id, " + flags_sql([
        ("run_id", "run_number = 12"),
        ("prompt_version", "run_number <> 12 AND run_number % 8 = 5"),
        ("inputs", "run_number <> 12 AND run_number % 6 = 1"),
        ("execution", "run_number <> 12 AND run_number % 7 = 2"),
        ("item_count", "run_number <> 12 AND items <> expected_ids"),
        ("item_fingerprint", "run_number <> 12 AND (items <> expected_ids OR run_number = 16)"),
        ("checkpoint_provenance", "run_number = 20"),
    ]) + " AS reasons FROM h",
)
def trial_resume(spark, sf_dir):
    """Trials that may be resumed and others; the inputs are fingerprints of the suppliers then and now."""
    number = F.col("run_number")
    results = bind(spark, sf_dir, "trial_results").withColumn("prompt_version", F.concat(F.lit("v"), number % 4 + 1))
    checkpoints = results.select(
        "run_id", "id", "state", "prompt_version", F.col("key_number").alias("position"), F.col("id").alias("classification_id"), F.col("version_prompt").alias("metadata_version"),
    )
    supplier = bind(spark, sf_dir, "supplier")
    revised = supplier.withColumn("s_name", F.when(F.col("s_suppkey") == 1, "revised").otherwise(F.col("s_name")))
    then, now = (P.table_digest(t).select(F.col("sha256").alias(name)) for t, name in ((supplier, "_then"), (revised, "_now")))
    digests = F.broadcast(then.join(now))  # one row
    headers = bind(spark, sf_dir, "trial_headers").join(digests)
    recorded = headers.select("run_id", F.lit(1).alias("schema_version"), "prompt_version", F.col("_then").alias("inputs"), "execution")
    recorded = recorded.join(G.outcome_digest(checkpoints), "run_id")
    planned = bind(spark, sf_dir, "requests").select(F.concat(F.lit("trial-"), F.col("key_number") % 40).alias("run_id"), "key_number", "id")
    moved = F.when(F.col("run_id") == "trial-16", -F.col("key_number")).otherwise(F.col("key_number"))
    digest = G.item_digest(planned.withColumn("position", moved))
    current = headers.where(number != 12).select(
        "run_id", F.when(number % 8 == 5, "v0").otherwise(F.col("prompt_version")).alias("prompt_version"), F.when(number % 6 == 1, F.col("_now")).otherwise(F.col("_then")).alias("inputs"),
        F.when(number % 7 == 2, "x-9").otherwise(F.col("execution")).alias("execution"),
    ).join(digest, "run_id")
    return G.resume_guard(recorded, current).select("run_id", listed(F.col("reasons")).alias("reasons"))
