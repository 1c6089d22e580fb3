"""Batch classification: mask, score, validate, check the summary's language, stamp."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice import fixed_values as V
from sluice import schemas
from sluice.functions.contract import classification_flags, conforms, split_valid
from sluice.functions.json_shape import ANSWER_TYPES, parse_strict, shape_flags
from sluice.functions.masking import mask_pii
from sluice.operators.rubric import rubric_answer
from sluice.sources.workspace import settle

Scorer = Callable[[DataFrame], DataFrame]
Policy = Callable[[DataFrame], DataFrame]


def stamp_provenance(rows: DataFrame, model: str, prompt_version: str, policy: str = V.LANGUAGE_POLICY) -> DataFrame:
    return (
        rows.withColumn("model", F.lit(model))
        .withColumn("version_prompt", F.lit(prompt_version))
        .withColumn("language_policy", F.lit(policy))
    )


def outcome_messages(outcomes: DataFrame, messages: DataFrame) -> DataFrame:
    """Outcomes with the text they are about."""
    return outcomes.join(messages, "id")


def masked_messages(messages: DataFrame, text: str = "message") -> DataFrame:
    """What a scorer may see: the raw text ends here."""
    others = [name for name in messages.columns if name != text]
    return messages.select(*others, mask_pii(F.col(text)).alias("masked_message"))


def parse_answers(answers: DataFrame, text: str = "answer") -> DataFrame:
    """JSON answers to typed fields. Strict: a wrong JSON shape leaves the fields null and names the reasons."""
    checked = answers.withColumn("_value", parse_strict(F.col(text)))
    checked = checked.withColumn("shape_violations", shape_flags(F.col(text), F.col("_value"), ANSWER_TYPES))
    parsed = F.when(F.size("shape_violations") == 0, F.from_json(text, schemas.ANSWER))
    return checked.withColumn("_parsed", parsed).select(
        *answers.columns, "shape_violations", *[f"_parsed.{name}" for name in ANSWER_TYPES]
    )


def validate_classifications(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that keep the whole contract, the others with their ``violations``)."""
    return split_valid(rows, classification_flags())


def failure_of(fine: Column, accepted: Column) -> Column:
    return F.when(~fine, "invalid_classification").when(
        ~F.coalesce(accepted, F.lit(False)), "invalid_summary_language"
    )


def classify(
    messages: DataFrame,
    scorer: Scorer = rubric_answer,
    policy: Policy | None = None,
    model: str = "rubric",
    prompt_version: str = "v1",
) -> DataFrame:
    """One outcome per message: ``succeeded`` with a classification, or ``failed`` with a category.

    ``scorer`` maps (id, masked_message) to the answer fields; ``policy`` maps (id, resumen) to
    (id, summary_accepted), one row per ID. IDs are unique after intake.
    """
    answered = stamp_provenance(scorer(masked_messages(messages).select("id", "masked_message")), model, prompt_version)
    checked = answered.withColumn("conforms", conforms(classification_flags()))
    if policy is None:
        checked = checked.withColumn("summary_accepted", F.lit(True))
    else:
        checked = settle(checked)  # the scorer runs once: the judged summary is the stored one
        checked = checked.join(policy(checked.select("id", "resumen")), "id", "left")
    category = failure_of(F.col("conforms"), F.col("summary_accepted"))
    checked = checked.withColumn("failure_category", category)
    fine = F.col("failure_category").isNull()
    return checked.select(
        "id",
        F.when(fine, "succeeded").otherwise("failed").alias("state"),
        "failure_category",
        F.when(fine, F.struct(*V.CLASSIFICATION_FIELDS)).alias("classification"),
        "model", F.col("version_prompt").alias("prompt_version"), "language_policy",
    )


def pandas_scorer(
    load_model: Callable[[], Callable[[pd.Series], pd.DataFrame]], max_tasks: int | None = None
) -> Scorer:
    """Adapter for a model outside Spark: loaded once per task, called on Arrow batches of masked text.

    ``max_tasks`` bounds how many calls run at a time across the cluster.
    """
    answer_fields = list(schemas.ANSWER.fieldNames())
    output = "id string, " + ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in schemas.ANSWER.fields)

    def score_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_model()
        for batch in batches:
            answers = model(batch["masked_message"])
            answers.insert(0, "id", batch["id"].to_numpy())
            yield answers[["id", *answer_fields]]

    def scorer(masked: DataFrame) -> DataFrame:
        rows = masked.select("id", "masked_message")
        if max_tasks is not None:
            rows = rows.repartition(max_tasks)
        return rows.mapInPandas(score_batches, output)

    return scorer
