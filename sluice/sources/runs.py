"""Run snapshots: a header plus one outcome per item."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice import schemas


def load_runs(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """Snapshots, one JSON document per line; ``array`` for one pretty-printed document per file."""
    return spark.read.schema(schemas.RUN).option("multiLine", array).option("mode", "FAILFAST").json(path)


def run_headers(runs: DataFrame) -> DataFrame:
    return runs.drop("outcomes")


def run_outcomes(runs: DataFrame) -> DataFrame:
    """One row per outcome with its place in the run and the run's version and budget."""
    return runs.select(
        "run_id", "prompt_version", F.col("execution.max_attempts").alias("max_attempts"),
        F.posexplode("outcomes").alias("position", "o"),
    ).select("run_id", "prompt_version", "max_attempts", "position", "o.*")


def accounting_outcomes(outcomes: DataFrame) -> DataFrame:
    """Outcomes in the flat form of the accounting operators."""
    names = (
        "model", "attempt", "input_tokens", "output_tokens", "cached_input_tokens", "estimated_cost_usd",
    )
    return outcomes.select(
        "run_id", "id", "state", "prompt_version", "max_attempts",
        *[F.col(f"result.metadata.{name}").alias(f"meta_{name}") for name in names],
    )
