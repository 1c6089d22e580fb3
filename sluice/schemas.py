"""Spark types of the stored records."""

from pyspark.sql import types as T

CONTENT = T.StructType([
    T.StructField("categoria", T.StringType()),
    T.StructField("prioridad", T.StringType()),
    T.StructField("area_sugerida", T.StringType()),
    T.StructField("idioma", T.StringType()),
    T.StructField("resumen", T.StringType()),
    T.StructField("requiere_info", T.BooleanType()),
    T.StructField("pregunta_seguimiento", T.StringType()),
])
ANSWER = T.StructType([*CONTENT.fields, T.StructField("confianza", T.DoubleType())])
CLASSIFICATION = T.StructType([
    *ANSWER.fields, T.StructField("id", T.StringType()), T.StructField("version_prompt", T.StringType()),
])
METADATA = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("attempt", T.IntegerType()),
    T.StructField("input_tokens", T.LongType()),
    T.StructField("output_tokens", T.LongType()),
    T.StructField("cached_input_tokens", T.LongType()),
    T.StructField("latency_ms", T.DoubleType()),
    T.StructField("estimated_cost_usd", T.DecimalType(38, 12)),
    T.StructField("prompt_version", T.StringType()),
])
MESSAGE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("source_area", T.StringType()),
    T.StructField("message", T.StringType()),
])
REFERENCE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("expected", CONTENT),
    T.StructField("justification", T.StringType()),
])
OUTCOME = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("failure_category", T.StringType()),
    T.StructField(
        "result",
        T.StructType([T.StructField("classification", CLASSIFICATION), T.StructField("metadata", METADATA)]),
    ),
])
FINGERPRINTS = T.StructType([
    T.StructField("prompt_sha256", T.StringType()),
    T.StructField("messages_sha256", T.StringType()),
    T.StructField("references_sha256", T.StringType()),
])
EXECUTION = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("timeout_seconds", T.DoubleType()),
    T.StructField("max_attempts", T.IntegerType()),
    T.StructField("concurrency_limit", T.IntegerType()),
    T.StructField("backoff_base_seconds", T.DoubleType()),
    T.StructField("backoff_max_seconds", T.DoubleType()),
    T.StructField("input_price_per_million", T.StringType()),
    T.StructField("output_price_per_million", T.StringType()),
    T.StructField("cached_input_price_per_million", T.StringType()),
    T.StructField(
        "summary_language_policy",
        T.StructType([
            T.StructField("id", T.StringType()),
            T.StructField("detector", T.StringType()),
            T.StructField("detector_version", T.StringType()),
        ]),
    ),
])
RUN = T.StructType([
    T.StructField("schema_version", T.IntegerType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("finished_at", T.StringType()),
    T.StructField("prompt_version", T.StringType()),
    T.StructField("inputs", FINGERPRINTS),
    T.StructField("execution", EXECUTION),
    T.StructField("outcomes", T.ArrayType(OUTCOME)),
])
REQUEST = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("raw_message", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("ai_classification", CLASSIFICATION),
    T.StructField("human_correction", CONTENT),
    T.StructField("provider_metadata", METADATA),
    T.StructField("effective_category", T.StringType()),
    T.StructField("effective_priority", T.StringType()),
    T.StructField("effective_area", T.StringType()),
    T.StructField("failure_code", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
    T.StructField("classified_at", T.TimestampType()),
    T.StructField("corrected_at", T.TimestampType()),
])
