"""Language identification and batch classification."""

import pandas as pd
from pyspark.sql import functions as F

from sluice.operators import language as L
from sluice.operators.accounting import account_usage
from sluice.operators.attempt_loop import classify_rounds
from sluice.operators.classification import classify, outcome_messages, pandas_scorer, stamp_provenance
from sluice.operators.corrections import fold_corrections
from sluice.operators.rubric import DEFAULT_LABELS, LEXICON, NO_HIT_CONFIDENCE, rubric_labels, rubric_scores
from sluice.plans.bindings import bind, bind_spread, stored_requests
from sluice.plans.catalog import query, words_sql
from sluice.plans.masking_queries import masked_ctes
from sluice.plans.request_queries import FOLD_CTES
from sluice.sources.files import prompt_files, valid_prompts
from sluice.sources.workspace import new_folder, settle


def grams_sql(source: str, columns: str, text: str) -> str:
    """One row per trigram, by index into the characters."""
    letters = f"concat(' ', trim(regexp_replace(lower({text}), '[^\\p{{L}}]+', ' ', 'g')), ' ')"
    return (
        f"SELECT {columns}, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS gram"
        f" FROM (SELECT {columns}, string_split({letters}, '') AS c FROM {source}) AS g_ WHERE len(c) > 2"
    )


PROFILE_CTES = (
    f"pc AS (SELECT lang, gram, count(*) AS n FROM ({grams_sql('{documents}', 'lang', 'text')}) AS g GROUP BY lang, gram),"
    " pt AS (SELECT lang, sum(n) AS total FROM pc GROUP BY lang),"
    " profile AS (SELECT gram, lang, CAST(round(ln(1.0 + (CAST(n AS DOUBLE) / CAST(total AS DOUBLE)) / 1e-6) * 1000) AS BIGINT) AS weight FROM pc JOIN pt USING (lang))"
)


def verdict_ctes(source: str, key: str, text: str) -> str:
    """``verdict``: the best language of every text, null where no trigram is known."""
    return (
        f"tg AS (SELECT {key} AS vk, gram, count(*) AS n FROM ({grams_sql(source, key, text)}) AS g GROUP BY 1, 2),"
        " sc AS (SELECT vk, lang, sum(n * weight) AS score FROM tg JOIN profile USING (gram) GROUP BY 1, 2),"
        " bs AS (SELECT vk, lang, row_number() OVER (PARTITION BY vk ORDER BY score DESC, lang) AS rn FROM sc),"
        f" verdict AS (SELECT v_.{key} AS vk, bs.lang AS lang_pred FROM {source} AS v_ LEFT JOIN bs ON bs.vk = v_.{key} AND rn = 1)"
    )


def _profile(spark, sf_dir):
    return L.build_lang_profile(bind_spread(spark, sf_dir, "documents"))


@query("langid_profile", f"WITH {PROFILE_CTES} SELECT gram, lang, weight FROM profile")
def langid_profile(spark, sf_dir):
    return _profile(spark, sf_dir)


@query(
    "langid_predict",
    f"WITH {PROFILE_CTES}, {verdict_ctes('{documents}', 'doc_id', 'text')} SELECT vk AS doc_id, lang_pred FROM verdict",
)
def langid_predict(spark, sf_dir):
    return L.predict_lang(bind_spread(spark, sf_dir, "documents"), "text", _profile(spark, sf_dir), "doc_id")


@query(
    "spanish_accepted",
    f"WITH {PROFILE_CTES}, {verdict_ctes('{messages}', 'id', 'message')} SELECT vk AS id, coalesce(lang_pred = 'es', false) AS summary_accepted FROM verdict",
)
def spanish_accepted(spark, sf_dir):
    return L.spanish_accepted(bind_spread(spark, sf_dir, "messages"), "message", _profile(spark, sf_dir))


@query(
    "summary_compliance",
    "SELECT source AS run_id, count(*) AS summaries, count(CASE WHEN lang = 'es' THEN 1 END) AS spanish,"
    f" count(CASE WHEN {words_sql('text')} BETWEEN 1 AND 20 THEN 1 END) AS within_limit FROM {{documents}} GROUP BY source",
)
def summary_compliance(spark, sf_dir):
    rows = bind_spread(spark, sf_dir, "documents").select(
        F.col("source").alias("run_id"), F.col("text").alias("resumen"), (F.col("lang") == "es").alias("summary_accepted")
    )
    return L.summary_compliance(rows)


LEXICON_SQL = ", ".join(
    f"('{dimension}', '{label}', {place}, '{word}', {weight})"
    for dimension, labels in LEXICON.items()
    for place, (label, words) in enumerate(labels.items())
    for word, weight in (words or {"": 0}).items()
)
LABELS_SQL = ", ".join(
    f"('{dimension}', '{label}', {place})" for dimension, labels in LEXICON.items() for place, label in enumerate(labels)
)


def rubric_ctes(source: str, text: str) -> str:
    return (
        f"tok AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')) AS word FROM {source}),"
        f" lex AS (SELECT * FROM (VALUES {LEXICON_SQL}) AS v(dimension, label, place, word, weight)),"
        f" lab AS (SELECT * FROM (VALUES {LABELS_SQL}) AS v(dimension, label, place)),"
        " hit AS (SELECT id, dimension, label, CAST(sum(weight) AS BIGINT) AS score FROM tok JOIN lex USING (word) GROUP BY 1, 2, 3),"
        f" rub AS (SELECT m_.id, lab.dimension, lab.label, lab.place, coalesce(hit.score, 0) AS score FROM {source} AS m_ JOIN lab ON true"
        " LEFT JOIN hit ON hit.id = m_.id AND hit.dimension = lab.dimension AND hit.label = lab.label),"
        " top AS (SELECT *, row_number() OVER (PARTITION BY id, dimension ORDER BY score DESC, place) AS rn, sum(score) OVER (PARTITION BY id, dimension) AS total FROM rub),"
        " cnt AS (SELECT id, count(*) AS words FROM tok GROUP BY id),"
        " lbl AS (SELECT top.id, "
        + ", ".join(
            f"max(CASE WHEN dimension = '{d}' THEN CASE WHEN score > 0 THEN label ELSE '{DEFAULT_LABELS[d]}' END END) AS {d}" for d in LEXICON
        )
        + f", max(CASE WHEN dimension = 'categoria' THEN CASE WHEN total > 0 THEN CAST(score AS DOUBLE) / CAST(total AS DOUBLE) ELSE {NO_HIT_CONFIDENCE} END END) AS confianza"
        " FROM top WHERE rn = 1 GROUP BY top.id)"
    )


@query("rubric_scores", f"WITH {rubric_ctes('{tickets}', 'message')} SELECT id, dimension, label, score FROM rub")
def scores(spark, sf_dir):
    return rubric_scores(bind_spread(spark, sf_dir, "tickets"))


@query(
    "rubric_labels",
    f"WITH {rubric_ctes('{tickets}', 'message')} SELECT lbl.id, categoria, prioridad, area_sugerida, idioma, round(confianza, 6) AS confianza, words AS word_count FROM lbl JOIN cnt USING (id)",
)
def labels(spark, sf_dir):
    rows = rubric_labels(bind_spread(spark, sf_dir, "tickets"))
    return rows.select(
        "id", "categoria", "prioridad", "area_sugerida", "idioma", F.round("confianza", 6).alias("confianza"),
        F.col("word_count").cast("long").alias("word_count"),
    )


SUMMARY_SQL = "concat('Solicitud interna de ', categoria, ' para el equipo de ', replace(area_sugerida, '_', ' '), ' con prioridad ', prioridad, '.')"


@query(
    "classify_batch",
    f"WITH {masked_ctes('{tickets}', 'message', 'id')}, {rubric_ctes('m7', 'masked')}, {PROFILE_CTES},"
    f" ans AS (SELECT lbl.*, words < 8 AS needs, {SUMMARY_SQL} AS resumen FROM lbl JOIN cnt USING (id)),"
    f" sums AS (SELECT DISTINCT resumen FROM ans), {verdict_ctes('sums', 'resumen', 'resumen')}"
    " SELECT id, CASE WHEN lang_pred = 'es' THEN 'succeeded' ELSE 'failed' END AS state, CASE WHEN lang_pred = 'es' THEN '' ELSE 'invalid_summary_language' END AS failure_category,"
    " CASE WHEN lang_pred = 'es' THEN categoria END AS categoria, CASE WHEN lang_pred = 'es' THEN prioridad END AS prioridad, CASE WHEN lang_pred = 'es' THEN area_sugerida END AS area_sugerida,"
    " CASE WHEN lang_pred = 'es' THEN ans.resumen END AS resumen, CASE WHEN lang_pred = 'es' THEN needs END AS requiere_info, 'v1' AS prompt_version"
    " FROM ans JOIN verdict ON vk = ans.resumen",
)
def classify_batch(spark, sf_dir):
    """Tickets masked, labelled by the rubric, validated, held to the language policy and stamped."""
    profile = _profile(spark, sf_dir)
    outcomes = classify(
        bind_spread(spark, sf_dir, "tickets"), policy=lambda summaries: L.spanish_accepted(summaries, "resumen", profile)
    )
    return outcomes.select(
        "id", "state", F.coalesce("failure_category", F.lit("")).alias("failure_category"),
        *[f"classification.{name}" for name in ("categoria", "prioridad", "area_sugerida", "resumen", "requiere_info")],
        "prompt_version",
    )


# A model that answers by the ticket's number and the attempt: failures worth a retry and others, bad labels, and a summary
# in another language.
TRIED_KIND = "CASE (number * 3 + attempt) % 9 WHEN 0 THEN 'timeout' WHEN 1 THEN 'refusal' WHEN 2 THEN 'label' WHEN 3 THEN 'other' WHEN 4 THEN 'rate_limit' ELSE 'good' END"
TRIED_SUMMARY = "CASE WHEN kind = 'other' THEN 'The thing was then there with others' ELSE 'Solicitud revisada para el equipo de datos' END"


def scripted_caller(rows):
    kinds = rows.selectExpr("id", "attempt", "CAST(substr(id, 3) AS BIGINT) AS number").selectExpr("*", f"{TRIED_KIND} AS kind")
    failed = F.col("kind").isin("timeout", "refusal", "rate_limit")
    structured = F.struct(
        F.when(F.col("kind") == "label", "queja").otherwise("datos").alias("categoria"), F.lit("alta").alias("prioridad"), F.lit("data").alias("area_sugerida"),
        F.lit("es").alias("idioma"), F.expr(TRIED_SUMMARY).alias("resumen"), F.lit(False).alias("requiere_info"), F.lit(None).cast("string").alias("pregunta_seguimiento"),
        F.lit(0.5).alias("confianza"),
    )
    return kinds.select(
        "id", F.when(~failed, structured).alias("structured"), F.when(failed, F.col("kind")).alias("error_type"), F.lit("model-a").alias("model"),
        F.when(~failed, F.col("attempt") * 100).cast("long").alias("input_tokens"), F.when(~failed, F.col("attempt") * 10).cast("long").alias("output_tokens"),
        F.lit(None).cast("long").alias("cached_input_tokens"), F.lit(1.0).alias("latency_ms"),
    )


def _tried(spark, sf_dir):
    profile = _profile(spark, sf_dir)

    def policy(summaries):
        """The verdict of each different summary once, given back to the rows that have it."""
        texts = settle(summaries)
        # Written down: Spark sees how small it is, and the rows are not gathered by their summary.
        verdict = settle(L.spanish_accepted(texts.select("resumen").distinct(), "resumen", profile, key="resumen"))
        return texts.join(verdict, "resumen").select("id", "summary_accepted")

    pricing = spark.sql("SELECT 'model-a' AS model, 1.5BD AS input_per_million, 2.5BD AS output_per_million, CAST(NULL AS DECIMAL(12, 6)) AS cached_input_per_million")
    return classify_rounds(bind_spread(spark, sf_dir, "tickets"), scripted_caller, policy, pricing, model="model-a")


TRIED_CTES = (
    f"{PROFILE_CTES}, calls AS (SELECT *, {TRIED_SUMMARY} AS resumen FROM (SELECT *, {TRIED_KIND} AS kind FROM"
    " (SELECT id, CAST(substr(id, 3) AS BIGINT) AS number, unnest([1, 2, 3]) AS attempt FROM {tickets}) AS n_) AS k_),"
    f" sums AS (SELECT DISTINCT resumen FROM calls), {verdict_ctes('sums', 'resumen', 'resumen')},"
    " judged AS (SELECT id, attempt, CASE WHEN kind IN ('timeout', 'refusal', 'rate_limit') THEN kind WHEN kind = 'label' THEN 'invalid_classification'"
    " WHEN lang_pred IS DISTINCT FROM 'es' THEN 'invalid_summary_language' END AS reason, kind NOT IN ('timeout', 'refusal', 'rate_limit') AS answered FROM calls JOIN verdict ON vk = resumen),"
    " ended AS (SELECT id, min(attempt) AS attempts FROM judged WHERE reason IS NULL OR reason = 'refusal' OR attempt = 3 GROUP BY id)"
)


@query(
    "classify_attempts",
    f"WITH {TRIED_CTES} SELECT j.id, CASE WHEN reason IS NULL THEN 'succeeded' ELSE 'failed' END AS state, reason AS failure_category, attempts,"
    " CASE WHEN reason IS NULL THEN 'datos' END AS categoria, CASE WHEN reason IS NULL THEN CAST(attempts * 100 AS BIGINT) END AS input_tokens,"
    " CASE WHEN reason IS NULL THEN CAST(attempts * 175 AS DOUBLE) / 1000000 END AS cost_usd FROM judged AS j JOIN ended AS e ON e.id = j.id AND attempts = attempt",
)
def classify_attempts(spark, sf_dir):
    """Tickets tried up to three times; outcomes with tokens and cost of the attempt that counts."""
    return _tried(spark, sf_dir).outcomes.select(
        "id", "state", "failure_category", "attempts", "classification.categoria", "metadata.input_tokens",
        F.col("metadata.estimated_cost_usd").cast("double").alias("cost_usd"),
    )


@query(
    "classify_attempt_usage",
    f"WITH {TRIED_CTES}, made AS (SELECT j.*, attempts FROM judged AS j JOIN ended AS e ON e.id = j.id AND attempt <= attempts)"
    " SELECT 'run-' || (CAST(substr(id, 3) AS BIGINT) % 5) AS run_id, count(*) AS observed_model_calls, CAST(sum(CASE WHEN answered THEN attempt * 100 ELSE 0 END) AS BIGINT) AS input_tokens,"
    " count(CASE WHEN reason IS NULL THEN 1 END) AS succeeded, count(CASE WHEN attempt = attempts AND reason IS NOT NULL THEN 1 END) AS failed_attempt_count_unknown FROM made GROUP BY 1",
)
def classify_attempt_usage(spark, sf_dir):
    """The same attempts as an attempt log, accounted by run."""
    found = _tried(spark, sf_dir)
    run = F.concat(F.lit("run-"), F.substring("id", 3, 18).cast("long") % 5)
    items = found.run_items(run, "v1", 3)
    summary, reasons = account_usage(found.events(run), items)
    unknown = reasons.where("reason = 'failed_attempt_count_unknown'").groupBy("run_id").agg(F.sum("occurrences").alias("failed_attempt_count_unknown"))
    good = items.groupBy("run_id").agg(F.count(F.when(F.col("state") == "succeeded", 1)).alias("succeeded"))
    return summary.join(good, "run_id").join(unknown, "run_id", "left").select(
        "run_id", "observed_model_calls", F.col("input_tokens_known_subtotal").cast("long").alias("input_tokens"), "succeeded",
        F.coalesce("failed_attempt_count_unknown", F.lit(0)).alias("failed_attempt_count_unknown"),
    )


def keyword_model():
    """A stand-in for a model outside Spark: one keyword, vectorised over the batch."""

    def answer(texts: pd.Series) -> pd.DataFrame:
        broken = texts.str.contains("error", regex=False)
        return pd.DataFrame({
            "categoria": broken.map({True: "bug", False: "consulta"}),
            "prioridad": broken.map({True: "alta", False: "urgente"}),
            "area_sugerida": "backend", "idioma": "es", "resumen": "Solicitud revisada por palabra clave.",
            "requiere_info": False, "pregunta_seguimiento": None, "confianza": broken.map({True: 0.9, False: 0.4}),
        })

    return answer


@query(
    "classify_plugin",
    "SELECT id, CASE WHEN contains(message, 'error') THEN 'succeeded' ELSE 'failed' END AS state,"
    " CASE WHEN contains(message, 'error') THEN '' ELSE 'invalid_classification' END AS failure_category,"
    " CASE WHEN contains(message, 'error') THEN 'bug' END AS categoria FROM {tickets}",
)
def classify_plugin(spark, sf_dir):
    """The same run with a pandas scorer; its invalid labels become failures."""
    outcomes = classify(bind_spread(spark, sf_dir, "tickets"), pandas_scorer(keyword_model, max_tasks=8), model="keyword")
    return outcomes.select(
        "id", "state", F.coalesce("failure_category", F.lit("")).alias("failure_category"), "classification.categoria"
    )


@query("outcome_messages", "SELECT o.id, o.state, r.raw_message FROM {outcomes_v1} AS o JOIN {requests} AS r USING (id)")
def joined_messages(spark, sf_dir):
    texts = bind(spark, sf_dir, "requests").select("id", "raw_message")
    return outcome_messages(bind(spark, sf_dir, "outcomes_v1").select("id", "state"), texts)


@query(
    "stamp_provenance",
    "SELECT id, 'model-a' AS model, 'v2' AS version_prompt, 'spanish-summary-v1' AS language_policy FROM {tickets}",
)
def stamped(spark, sf_dir):
    return stamp_provenance(bind_spread(spark, sf_dir, "tickets").select("id"), "model-a", "v2")


@query(
    "prompt_versions",
    "WITH p AS (SELECT CASE WHEN source = 'src3' THEN 'borrador' WHEN source = 'src4' THEN 'v0' ELSE concat('v', CAST(substr(source, 4) AS BIGINT) + 1) END AS version,"
    " CASE WHEN source = 'src5' THEN 0 ELSE count(*) END AS texts FROM {documents} GROUP BY source)"
    " SELECT version, concat('Documents: ', texts) AS content FROM p WHERE texts > 0 AND version <> 'borrador' AND version <> 'v0'",
)
def prompt_versions(spark, sf_dir):
    """Prompt files, one per document source, written as vN.md folders and loaded with the checks on name and content."""
    counted = bind_spread(spark, sf_dir, "documents").groupBy("source").count()
    number = F.substring("source", 4, 10).cast("long") + 1
    name = F.when(F.col("source") == "src3", "borrador").when(F.col("source") == "src4", "v0").otherwise(F.concat(F.lit("v"), number))
    content = F.when(F.col("source") == "src5", "  ").otherwise(F.concat(F.lit("Documents: "), "count"))
    path = new_folder(spark, "prompts")
    counted.select(name.alias("version"), content.alias("value")).write.partitionBy("version").text(path)
    return valid_prompts(prompt_files(spark, path)).withColumn("content", F.rtrim(F.translate("content", "\n", " ")))


# The one-by-one fold over corrections whose summaries are judged by language first.
JUDGED_FOLD = (
    FOLD_CTES.replace("FROM {corrections})", "FROM {judged_corrections} AS k_ LEFT JOIN verdict ON vk = k_.resumen)")
    .replace("WHEN fold.state <> 'completed'", "WHEN c.has_resumen AND (c.resumen IS NULL OR c.lang_pred IS DISTINCT FROM 'es') THEN 'summary_language' WHEN fold.state <> 'completed'")
)
JUDGED_CTES = f"{PROFILE_CTES}, sums AS (SELECT DISTINCT resumen FROM {{judged_corrections}} WHERE resumen IS NOT NULL), {verdict_ctes('sums', 'resumen', 'resumen')}"


@query(
    "correction_policy",
    f"WITH RECURSIVE {JUDGED_CTES}, {JUDGED_FOLD} SELECT id, seq, reason FROM fold WHERE n > 0 AND reason <> ''"
    " UNION ALL SELECT id, seq, CASE WHEN NOT (has_categoria OR has_prioridad OR has_area_sugerida OR has_idioma OR has_resumen OR has_requiere_info OR has_pregunta_seguimiento) THEN 'empty'"
    " WHEN has_resumen AND (resumen IS NULL OR lang_pred IS DISTINCT FROM 'es') THEN 'summary_language' ELSE 'not_found' END FROM c WHERE id NOT IN (SELECT id FROM {requests})",
)
def correction_policy(spark, sf_dir):
    """Rejected corrections under the language policy: summaries in another language or none, and IDs that nobody sent."""
    profile = _profile(spark, sf_dir)
    requests = stored_requests(bind(spark, sf_dir, "requests"))
    _, rejected = fold_corrections(requests, bind_spread(spark, sf_dir, "judged_corrections"), policy=lambda rows: L.spanish_accepted(rows, "resumen", profile))
    return rejected.select("id", "seq", "reason")
