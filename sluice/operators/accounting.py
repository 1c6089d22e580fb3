"""Token and cost accounting of runs over their attempt logs.

Events are reduced to one row per (run, message, attempt) before any join, keeping the first seen and counting
the rest, so a message that holds a large share of a log costs no more than its distinct attempts.
Events: run_id, line (any orderable position), message_id, attempt (null unless a JSON integer), model,
prompt_version, success, input_tokens, output_tokens, cached_input_tokens, estimated_cost_usd.
Outcomes: run_id, id, state, prompt_version, max_attempts and the result metadata as meta_*.

Messages are joined by sort and merge at every size: Spark takes outcomes that were read from small files for small, and would
gather them on the driver to broadcast them.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.money import COST, known_sum
from sluice.sources.workspace import settle

PAYLOAD = (
    "model", "prompt_version", "success", "input_tokens", "output_tokens", "cached_input_tokens",
    "estimated_cost_usd",
)


def valid_attempt() -> Column:
    return F.coalesce(F.col("attempt") >= 1, F.lit(False))


def distinct_attempts(events: DataFrame) -> DataFrame:
    """First-seen event of every (run, message, attempt), and how many events claimed that attempt."""
    first = F.min(F.struct("line", *PAYLOAD)).alias("first")
    return events.groupBy("run_id", "message_id", "attempt").agg(first, F.count("*").alias("events"))


def matched_attempts(distinct: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Distinct attempts with ``known``: whether the message belongs to the run."""
    ids = outcomes.select("run_id", F.col("id").alias("message_id"), F.lit(True).alias("_known"))
    joined = distinct.join(ids.hint("merge"), ["run_id", "message_id"], "left")
    return joined.withColumn("known", F.coalesce("_known", F.lit(False))).drop("_known")


def event_reasons(matched: DataFrame) -> DataFrame:
    """Foreign, invalid and duplicate events. A foreign message's ID is not repeated in the report."""
    invalid = F.col("known") & ~valid_attempt()
    reason = (
        F.when(~F.col("known"), "foreign_message_event")
        .when(invalid, "invalid_attempt")
        .when(F.col("events") > 1, "duplicate_attempt")
    )
    extra = F.when(F.col("known") & ~invalid, F.col("events") - 1).otherwise(F.col("events"))
    return (
        matched.withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .groupBy("run_id", F.when(F.col("known"), F.col("message_id")).alias("message_id"), "reason")
        .agg(F.sum(extra).alias("occurrences"))
    )


def sequences(matched: DataFrame) -> DataFrame:
    """Per (run, message) what its distinct attempts look like; attempt payloads stay out of lists."""
    used = matched.where(F.col("known") & valid_attempt())
    final = F.struct("attempt", F.col("first.success").alias("success"), *[f"first.{name}" for name in PAYLOAD if name != "success"])
    return used.groupBy("run_id", "message_id").agg(
        F.count("*").alias("attempts"),
        F.max("attempt").alias("last_attempt"),
        F.max(final).alias("final"),
        F.count(F.when(~F.col("first.success").eqNullSafe(F.lit(False)), 1)).alias("not_failed"),
        F.min(F.coalesce("first.prompt_version", F.lit(""))).alias("min_version"),
        F.max(F.coalesce("first.prompt_version", F.lit(""))).alias("max_version"),
    )


def attempt_gaps(sequence: DataFrame) -> DataFrame:
    """Distinct attempts >= 1 are the full range 1..n exactly when there are n of them and n is the largest."""
    return sequence.select(
        "run_id", "message_id", "attempts", "last_attempt",
        (F.col("attempts") == F.col("last_attempt")).alias("gap_free"),
    )


def _final_differs() -> Column:
    same_numbers = F.lit(True)
    for name in ("input_tokens", "output_tokens", "cached_input_tokens"):
        same_numbers = same_numbers & F.col(f"final.{name}").eqNullSafe(F.col(f"meta_{name}"))
    same_cost = F.col("final.estimated_cost_usd").cast("string").try_cast(COST).eqNullSafe(
        F.col("meta_estimated_cost_usd").cast(COST)
    )
    return ~(
        F.col("final.success").eqNullSafe(F.lit(True))
        & F.col("final.model").eqNullSafe(F.col("meta_model"))
        & F.col("final.prompt_version").eqNullSafe(F.col("prompt_version"))
        & same_numbers
        & same_cost
    )


def final_attempt_consistency(sequence: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Succeeded items whose recorded final attempt is the last one seen, and whether both agree."""
    joined = outcomes.where(F.col("state") == "succeeded").join(
        sequence.withColumnRenamed("message_id", "id"), ["run_id", "id"]
    )
    return joined.where(F.col("last_attempt") == F.col("meta_attempt")).select(
        "run_id", "id", "meta_attempt", (~_final_differs()).alias("consistent")
    )


def prior_attempts_failed(sequence: DataFrame) -> DataFrame:
    """Whether every attempt before the last is a recorded failure; an unknown result is not a failure."""
    last_not_failed = F.when(F.col("final.success").eqNullSafe(F.lit(False)), 0).otherwise(1)
    return sequence.select(
        "run_id", "message_id", "last_attempt", ((F.col("not_failed") - last_not_failed) == 0).alias("prior_failed")
    )


def outcome_reasons(sequence: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Why an outcome's attempts do not account for it: the first structural reason, or up to three others."""
    joined = outcomes.join(sequence.withColumnRenamed("message_id", "id").hint("merge"), ["run_id", "id"], "left")
    seen = F.col("attempts").isNotNull()
    final = F.col("meta_attempt")
    broken = ~F.coalesce(
        (final >= 1)
        & (F.col("max_attempts").isNull() | (final <= F.col("max_attempts")))
        & (F.col("attempts") == final)
        & (F.col("last_attempt") == final),
        F.lit(False),
    )
    structural = (
        F.when((F.col("state") == "pending") & seen, "pending_has_attempts")
        .when(F.col("state") == "pending", "")
        .when(F.col("state").isin("running", "interrupted_unknown"), "unknown_outcome")
        .when(~seen, "missing_attempt")
        .when(F.col("state") == "failed", "failed_attempt_count_unknown")
        .when(broken, "incomplete_attempt_sequence")
    )
    last_not_failed = F.when(F.col("final.success").eqNullSafe(F.lit(False)), 0).otherwise(1)
    version = F.coalesce("prompt_version", F.lit(""))
    checks = F.array(
        F.when((F.col("not_failed") - last_not_failed) > 0, "inconsistent_attempt_result"),
        F.when(_final_differs(), "inconsistent_success_metadata"),
        F.when(
            (F.col("min_version") != version) | (F.col("max_version") != version), "inconsistent_attempt_provenance"
        ),
    )
    reasons = F.when(structural.isNotNull(), F.array(structural)).otherwise(checks)
    return (
        joined.select("run_id", F.col("id").alias("message_id"), F.explode(reasons).alias("reason"))
        .where(F.col("reason").isNotNull() & (F.col("reason") != ""))
        .withColumn("occurrences", F.lit(1).cast("long"))
    )


def line_reasons(bad_lines: DataFrame) -> DataFrame:
    return (
        bad_lines.groupBy("run_id", "reason")
        .agg(F.count("*").alias("occurrences"))
        .select("run_id", F.lit(None).cast("string").alias("message_id"), "reason", "occurrences")
    )


def account_usage(
    events: DataFrame, outcomes: DataFrame, bad_lines: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(per-run summary, reasons). ``occurrences`` says how often a reason applies to a message.

    The distinct attempts are written down once: sums, sequences and event reasons all read them, the log is
    read a single time.
    """
    matched = settle(matched_attempts(distinct_attempts(events), outcomes))
    sequence = sequences(matched)
    reasons = event_reasons(matched).unionByName(outcome_reasons(sequence, outcomes))
    if bad_lines is not None:
        reasons = reasons.unionByName(line_reasons(bad_lines))
    used = F.col("known") & valid_attempt()

    def known(name: str) -> Column:
        return F.when(used, F.col(f"first.{name}"))

    sums = matched.groupBy("run_id").agg(
        F.sum("events").alias("observed_model_calls"),
        known_sum(known("input_tokens")).alias("input_tokens_known_subtotal"),
        known_sum(known("output_tokens")).alias("output_tokens_known_subtotal"),
        known_sum(known("estimated_cost_usd").cast("string").try_cast(COST)).alias("estimated_cost_usd_known_subtotal"),
        F.count(F.when(used & (F.col("first.input_tokens").isNull() | F.col("first.output_tokens").isNull()), 1)).alias(
            "_unknown_usage"
        ),
        F.count(F.when(used & F.col("first.estimated_cost_usd").isNull(), 1)).alias("_unknown_cost"),
    )
    runs = outcomes.groupBy("run_id").agg(F.count("*").alias("_items"))
    why = reasons.groupBy("run_id").agg(F.sum("occurrences").alias("incomplete_reasons"))
    summary = runs.join(sums, "run_id", "left").join(why, "run_id", "left")
    clean = F.coalesce("incomplete_reasons", F.lit(0)) == 0
    summary = summary.select(
        "run_id",
        *[
            F.coalesce(name, F.lit(0)).alias(name)
            for name in ("observed_model_calls", "input_tokens_known_subtotal", "output_tokens_known_subtotal")
        ],
        F.coalesce("estimated_cost_usd_known_subtotal", F.lit(0).cast(COST)).alias("estimated_cost_usd_known_subtotal"),
        (clean & (F.coalesce("_unknown_usage", F.lit(0)) == 0)).alias("usage_complete"),
        (clean & (F.coalesce("_unknown_cost", F.lit(0)) == 0)).alias("cost_complete"),
        F.coalesce("incomplete_reasons", F.lit(0)).alias("incomplete_reasons"),
    )
    return summary, reasons


def actual_models(outcomes: DataFrame) -> DataFrame:
    """Models that really answered, per run, as sorted rows."""
    return (
        outcomes.where(F.col("state") == "succeeded").select("run_id", F.col("meta_model").alias("model"))
        .distinct()
        .orderBy("run_id", "model")
    )


def latency_stats(events: DataFrame) -> DataFrame:
    return events.groupBy("run_id").agg(
        F.min("latency_ms").alias("min_latency_ms"),
        F.max("latency_ms").alias("max_latency_ms"),
        F.avg("latency_ms").alias("mean_latency_ms"),
    )
