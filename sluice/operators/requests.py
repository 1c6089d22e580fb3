"""Stored requests: projections, listing, idempotent intake and the guarded lifecycle."""

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice import fixed_values as V
from sluice.functions.text import is_blank
from sluice.operators.skew import HOT_ROWS, attach
from sluice.sources.workspace import settle


def content_of(classification: Column) -> Column:
    """The content fields of a classification; null when there is none."""
    return F.when(
        classification.isNotNull(),
        F.struct(*[classification.getField(name).alias(name) for name in V.CONTENT_FIELDS]),
    )


def effective_classification() -> Column:
    """The latest correction if there is one, else the labelled content, else null."""
    return F.coalesce(F.col("human_correction"), content_of(F.col("ai_classification")))


def request_summary(requests: DataFrame) -> DataFrame:
    """Everything a listing shows; the raw message is left out."""
    return requests.select(
        "id", "state", "ai_classification", "human_correction",
        effective_classification().alias("effective_classification"),
        "provider_metadata", "created_at", "updated_at", "classified_at", "corrected_at",
    )


def request_detail(requests: DataFrame) -> DataFrame:
    return requests.select(
        "id", "state", "ai_classification", "human_correction",
        effective_classification().alias("effective_classification"),
        "provider_metadata", "created_at", "updated_at", "classified_at", "corrected_at",
        F.col("raw_message").alias("mensaje"),
    )


def in_progress(requests: DataFrame) -> DataFrame:
    return requests.where(F.col("state") == "processing").select("id", "state", "created_at")


def completed_matching(
    requests: DataFrame, category: str | None = None, priority: str | None = None, area: str | None = None
) -> DataFrame:
    """Completed requests, optionally with equal effective labels; the filters reach the parquet scan."""
    chosen = (
        ("effective_category", category, V.CATEGORIES),
        ("effective_priority", priority, V.PRIORITIES),
        ("effective_area", area, V.AREAS),
    )
    condition = F.col("state") == "completed"
    for column, value, domain in chosen:
        if value is None:
            continue
        if value not in domain:
            raise ValueError(f"{value!r} is not a label of {column}.")
        condition = condition & (F.col(column) == value)
    return requests.where(condition)


def list_requests(
    requests: DataFrame,
    category: str | None = None,
    priority: str | None = None,
    area: str | None = None,
    limit: int = V.PAGE_DEFAULT,
    offset: int = 0,
) -> DataFrame:
    """Newest first, ties by descending ID. For deep pages use ``list_after``."""
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= V.PAGE_MAX:
        raise ValueError(f"limit must be an integer from 1 to {V.PAGE_MAX}.")
    if isinstance(offset, bool) or not isinstance(offset, int) or offset < 0:
        raise ValueError("offset must be an integer of 0 or more.")
    page = completed_matching(requests, category, priority, area)
    return page.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)


def list_after(
    requests: DataFrame, created_at: datetime, request_id: str, limit: int = V.PAGE_DEFAULT, **labels: str
) -> DataFrame:
    """The page after a known row: the cost does not grow with the page number."""
    seen = F.lit(created_at)
    older = (F.col("created_at") < seen) | ((F.col("created_at") == seen) & (F.col("id") < request_id))
    return list_requests(requests.where(F.col("created_at") <= seen).where(older), limit=limit, **labels)


def lookup(requests: DataFrame, ids: DataFrame) -> DataFrame:
    """Stored requests with one of the given IDs."""
    return requests.join(ids.select("id"), "id", "left_semi")


def first_writer(submissions: DataFrame, order: list[str]) -> DataFrame:
    """Per ID the first submission, and how many there were.

    A partial aggregate: a hot ID is reduced to one row per task before the shuffle. ``order`` has to put
    any two submissions of an ID in order.
    """
    first = F.min(F.struct(*order, *(() if "raw_message" in order else ("raw_message",))))
    return (
        submissions.groupBy("id")
        .agg(first.alias("_first"), F.count("*").alias("_rows"))
        .select("id", F.col("_first.raw_message").alias("first_message"), "_first", "_rows")
    )


def intake(
    submissions: DataFrame, order: list[str], stored: DataFrame | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Every submission with its outcome.

    ``invalid``: null or blank ID or text; such rows reserve nothing. ``created``: reserves the ID, and is exactly one
    row of an ID, also where a submission was delivered several times. ``duplicate``: same ID, same exact text. ``conflict``: same ID, other text.
    With ``stored`` (id, raw_message, state) a repeat of a stored request is told apart by its state:
    ``duplicate_completed``, ``in_progress``, ``failed_terminal``; stored IDs are never reserved again.
    A stored ID that is given twice counts once, with the smallest (state, text).
    """
    # Settled, so that the places that tell equal submissions apart stay the same in every later reading.
    placed = settle(submissions.withColumn("_place", F.monotonically_increasing_id()))
    unfit = [F.col(name).isNull() | is_blank(F.col(name)) for name in ("id", "raw_message")]
    valid = ~(unfit[0] | unfit[1])
    order = [*order, "raw_message", "_place"]
    firsts = first_writer(placed.where(valid), order)
    if stored is None:
        firsts = firsts.withColumn("_stored_message", F.lit(None).cast("string"))
        firsts = firsts.withColumn("_state", F.lit(None).cast("string"))
    else:
        known = stored.groupBy("id").agg(F.min(F.struct("state", "raw_message")).alias("_known"))
        known = known.select("id", F.col("_known.raw_message").alias("_stored_message"), F.col("_known.state").alias("_state"))
        firsts = firsts.join(known, "id", "left")
    rows = attach(placed, firsts, ["id"], order, hot_rows=hot_rows)
    owner = F.coalesce("_stored_message", "first_message")
    is_first = F.col("_place") == F.col("_first._place")
    outcome = (
        F.when(~valid, "invalid")
        .when(F.col("raw_message") != owner, "conflict")
        .when(F.col("_state") == "completed", "duplicate_completed")
        .when(F.col("_state") == "processing", "in_progress")
        .when(F.col("_state") == "failed", "failed_terminal")
        .when(is_first, "created")
        .otherwise("duplicate")
    )
    return rows.withColumn("outcome", outcome).select(*submissions.columns, "outcome")


def request_times(submissions: DataFrame, events: DataFrame, corrections: DataFrame) -> DataFrame:
    """Created / classified / corrected / updated times per ID, each from its own kind of row.

    The creation time is the first arrival and a correction never moves it.
    """
    created = submissions.groupBy("id").agg(F.min("arrival").alias("created_at"))
    classified = events.groupBy("id").agg(F.min("ts").alias("classified_at"))
    corrected = corrections.groupBy("id").agg(F.max("ts").alias("corrected_at"))
    return (
        created.join(classified, "id", "left")
        .join(corrected, "id", "left")
        .withColumn("updated_at", F.coalesce("corrected_at", "classified_at", "created_at"))
    )


def first_terminal(events: DataFrame, order: list[str]) -> DataFrame:
    first = F.min(F.struct(*order, "target", "failure_code"))
    return events.groupBy("id").agg(first.alias("_first"), F.count("*").alias("_rows"))


def lifecycle(
    requests: DataFrame, events: DataFrame, order: list[str], hot_rows: int = HOT_ROWS
) -> tuple[DataFrame, DataFrame]:
    """(id and new state, every event with its verdict).

    Only processing -> completed and processing -> failed exist, so the first terminal event of a processing
    request applies and every other event is turned away.
    """
    firsts = first_terminal(events, order)
    states = requests.select("id", "state")
    moved = states.join(firsts, "id", "left").select(
        "id",
        F.col("state").alias("old_state"),
        F.when((F.col("state") == "processing") & F.col("_first").isNotNull(), F.col("_first.target"))
        .otherwise(F.col("state"))
        .alias("state"),
        F.when(
            (F.col("state") == "processing") & (F.col("_first.target") == "failed"), F.col("_first.failure_code")
        ).alias("new_failure_code"),
    )
    per_key = firsts.join(states, "id", "left")
    is_first = F.struct(*order, "target", "failure_code") == F.col("_first")
    verdict = (
        F.when(F.col("state").isNull(), "not_found")
        .when(F.col("state") != "processing", "not_processing")
        .when(is_first, "applied")
        .otherwise("not_processing")
    )
    routed = attach(events, per_key, ["id"], order, hot_rows=hot_rows)
    return moved, routed.withColumn("verdict", verdict).select(*events.columns, "verdict")
