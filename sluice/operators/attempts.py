"""Failure kinds and the outcome of a bounded series of attempts."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice import fixed_values as V


def fatal_kinds() -> list[str]:
    return [kind for kind, _, fatal in V.ERROR_KINDS if fatal]


def retryable_kinds() -> list[str]:
    return [kind for kind, retryable, _ in V.ERROR_KINDS if retryable]


def error_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(V.ERROR_KINDS), "error_type string, retryable boolean, fatal boolean")


def kind_of_status(status: Column) -> Column:
    """HTTP status of a failed call to its failure kind."""
    return (
        F.when(status.isin(401, 403), "authentication")
        .when(status == 429, "rate_limit")
        .when(status.isin(408, 409) | (status >= 500), "server_error")
        .when(status.isin(400, 404, 422), "configuration")
        .otherwise("provider_error")
    )


def resolve_attempts(attempts: DataFrame, budget: int = V.ATTEMPT_BUDGET) -> DataFrame:
    """Candidate attempts (id, attempt, line, success, error_type, ...) to one outcome per ID.

    Within the budget the first success or non-retryable failure decides; otherwise the last failure stands.
    Both are minima and maxima, so one partial aggregate does it without ordering any ID's attempts.
    """
    payload = F.struct("attempt", "line", "success", "error_type")
    stops = F.coalesce(F.col("success"), F.lit(False)) | ~F.coalesce(
        F.col("error_type").isin(*retryable_kinds()), F.lit(False)
    )
    resolved = (
        attempts.where(F.col("attempt").between(1, budget))
        .groupBy("id")
        .agg(F.min(F.when(stops, payload)).alias("_stop"), F.max(payload).alias("_last"))
        .select("id", F.coalesce("_stop", "_last").alias("_final"))
    )
    succeeded = F.coalesce(F.col("_final.success"), F.lit(False))
    return resolved.select(
        "id",
        F.when(succeeded, "succeeded").otherwise("failed").alias("state"),
        F.col("_final.attempt").alias("attempt"),
        F.when(~succeeded, F.coalesce(F.col("_final.error_type"), F.lit("unexpected_error"))).alias("failure_category"),
    )
