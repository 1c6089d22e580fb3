"""Classification with a bounded series of attempts, as rounds over what is still open.

Round n calls the model for the messages that no earlier round has settled, and only for them: the rest is an anti-join
that shrinks from round to round. Every round is written down before it is looked at, so a call is made once however often
its answer is used, and a lost executor repeats the calls of its own tasks only. An attempt is settled by an answer
that keeps the contract and the language policy, by a failure that is not worth a retry, or by the last round.

Joins by ID are sorted and merged at every size: by the size of its files Spark takes a table of many constant columns for
small, and would gather all its IDs on the driver to broadcast them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice import fixed_values as V
from sluice import schemas
from sluice.functions.contract import classification_flags, conforms
from sluice.functions.json_shape import ANSWER_TYPES
from sluice.functions.money import COST, token_cost
from sluice.functions.text import is_blank
from sluice.operators.attempts import retryable_kinds
from sluice.operators.classification import Policy, masked_messages, parse_answers
from sluice.sources.workspace import settle

#: (id, masked_message, attempt) to one row for each: id, ``answer`` (JSON text) or ``structured`` (typed fields), and
#: error_type (null if there is an answer), model, input_tokens, output_tokens, cached_input_tokens, latency_ms.
Caller = Callable[[DataFrame], DataFrame]
USAGE = ("input_tokens", "output_tokens", "cached_input_tokens")


@dataclass(frozen=True)
class Classified:
    """``outcomes`` (id, state, failure_category, classification, metadata) and the ``attempts`` behind them, one row a call."""

    outcomes: DataFrame
    attempts: DataFrame

    def finished(self, at: Column) -> DataFrame:
        """What ``upsert_requests`` takes: id, at, classification, metadata, error_type."""
        return self.outcomes.where(F.col("attempts") > 0).select("id", at.alias("at"), "classification", "metadata", F.col("failure_category").alias("error_type"))

    def events(self, run_id: Column) -> DataFrame:
        """Attempt events as ``account_usage`` takes them."""
        return self.attempts.select(
            run_id.alias("run_id"), F.concat_ws("#", "id", F.lpad(F.col("attempt").cast("string"), 6, "0")).alias("line"), F.col("id").alias("message_id"),
            F.col("attempt").cast("long").alias("attempt"), "model", "prompt_version", "success", *USAGE, F.col("estimated_cost_usd").cast("string").alias("estimated_cost_usd"),
        )

    def run_items(self, run_id: Column, prompt_version: str, max_attempts: int) -> DataFrame:
        """Outcomes as ``account_usage`` takes them."""
        return self.outcomes.select(
            run_id.alias("run_id"), "id", "state", F.lit(prompt_version).alias("prompt_version"), F.lit(max_attempts).alias("max_attempts"),
            *[F.col(f"metadata.{n}").alias(f"meta_{n}") for n in ("model", "attempt", *USAGE, "estimated_cost_usd")],
        )


def _judged(answered: DataFrame, policy: Policy | None, pricing: DataFrame | None, model: str, prompt_version: str) -> DataFrame:
    """Answers with typed fields, cost and the reason why they do not count, null if they do."""
    if "structured" in answered.columns:
        typed = answered.select("*", *[F.col(f"structured.{name}").alias(name) for name in ANSWER_TYPES])
        well_formed = F.col("structured").isNotNull()
    else:
        typed = parse_answers(answered)
        well_formed = F.size("shape_violations") == 0
    typed = typed.withColumn("version_prompt", F.lit(prompt_version)).withColumn("model", F.coalesce("model", F.lit(model)))
    broken = ~(well_formed & conforms(classification_flags()))
    typed = typed.withColumn("_reason", F.when(F.col("error_type").isNotNull(), F.col("error_type")).when(broken, "invalid_classification"))
    if policy is not None:
        typed = settle(typed)  # read for the summaries and for the rows
        verdict = policy(typed.where(F.col("_reason").isNull()).select("id", "resumen"))
        typed = typed.join(verdict.select("id", "summary_accepted").hint("merge"), "id", "left")
        spanish = F.coalesce("summary_accepted", F.lit(False))
        typed = typed.withColumn("_reason", F.coalesce("_reason", F.when(~spanish, "invalid_summary_language")))
    if pricing is None:
        return typed.withColumn("cost_usd", F.lit(None).cast(COST))
    return token_cost(typed, pricing)


def classify_rounds(
    messages: DataFrame, caller: Caller, policy: Policy | None = None, pricing: DataFrame | None = None,
    model: str = "model", prompt_version: str = "v1", max_attempts: int = V.ATTEMPT_BUDGET,
) -> Classified:
    """One outcome for each message (id, message) and one attempt row for each call.

    Failures: the caller's ``error_type``; ``invalid_classification`` for an answer that breaks the contract;
    ``invalid_summary_language``; ``unexpected_error`` for a message that the caller gave no row for, or several.
    Kinds that are worth a retry are called again while attempts are left. A null or blank id is never called and fails
    as ``unexpected_error`` with no attempt. IDs are unique after intake; of repeated ones each call counts.
    """
    if max_attempts < 1:
        raise ValueError("At least one attempt.")
    named = ~F.coalesce(is_blank(F.col("id")), F.lit(True))
    open_rows = settle(masked_messages(messages).select("id", "masked_message").where(named))
    final, attempts = [], []
    for number in range(1, max_attempts + 1):
        called = settle(caller(open_rows.withColumn("attempt", F.lit(number))))
        # The caller's single row for an ID; without one, or with several, the call has failed.
        rows = called.groupBy("id").agg(F.count("*").alias("_answers"), F.first(F.struct(*called.columns)).alias("_row"))
        once = rows.where("_answers = 1").select("id", "_answers", *[F.col("_row")[name].alias(name) for name in called.columns if name != "id"])
        answered = open_rows.select("id").join(once.hint("merge"), "id", "left")
        answered = answered.withColumn("error_type", F.when(F.col("_answers").isNull(), "unexpected_error").otherwise(F.col("error_type"))).drop("_answers")
        judged = settle(_judged(answered, policy, pricing, model, prompt_version))
        good, again = F.col("_reason").isNull(), F.coalesce(F.col("_reason").isin(*retryable_kinds()), F.lit(False))
        attempts.append(
            judged.select(
                "id", F.lit(number).alias("attempt"), "model", F.lit(prompt_version).alias("prompt_version"), F.col("latency_ms").cast("double").alias("latency_ms"),
                *[F.col(name).cast("long").alias(name) for name in USAGE], F.col("cost_usd").alias("estimated_cost_usd"), good.alias("success"), F.col("_reason").alias("error_type"),
            )
        )
        settled = judged if number == max_attempts else judged.where(good | ~again)
        metadata = F.struct(
            "model", F.lit(number).alias("attempt"), *[F.col(name).cast("long").alias(name) for name in USAGE],
            F.col("latency_ms").cast("double").alias("latency_ms"), F.col("cost_usd").alias("estimated_cost_usd"), F.lit(prompt_version).alias("prompt_version"),
        )
        final.append(
            settled.select(
                "id", F.when(good, "succeeded").otherwise("failed").alias("state"), F.col("_reason").alias("failure_category"),
                F.when(good, F.struct(*V.CLASSIFICATION_FIELDS)).cast(schemas.CLASSIFICATION).alias("classification"),
                F.when(good, metadata).cast(schemas.METADATA).alias("metadata"), F.lit(number).alias("attempts"),
            )
        )
        if number < max_attempts:
            open_rows = settle(open_rows.join(settled.select("id").hint("merge"), "id", "left_anti"))
            if open_rows.isEmpty():
                break
    nothing = lambda kind: F.lit(None).cast(kind)
    final.append(
        messages.where(~named).select(
            "id", F.lit("failed").alias("state"), F.lit("unexpected_error").alias("failure_category"),
            nothing(schemas.CLASSIFICATION).alias("classification"), nothing(schemas.METADATA).alias("metadata"), F.lit(0).alias("attempts"),
        )
    )
    return Classified(reduce(DataFrame.unionByName, final), reduce(DataFrame.unionByName, attempts))
