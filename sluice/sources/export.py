"""Result export and report tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice import fixed_values as V


def exportable(outcomes: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: item counts and whether every expected ID succeeded once under its own identity and version.

    Outcomes: id, state, classification, metadata_version, prompt_version. Counting per ID comes first, so
    repeated IDs stay cheap.
    """
    fine = (
        (F.col("state") == "succeeded")
        & F.col("classification.id").eqNullSafe(F.col("id"))
        & F.col("metadata_version").eqNullSafe(F.col("prompt_version"))
    )
    per_id = outcomes.groupBy("id").agg(F.count("*").alias("_rows"), F.bool_and(F.coalesce(fine, F.lit(False))).alias("_ok"))
    both = expected.select("id", F.lit(1).alias("_expected")).join(per_id, "id", "full_outer")
    ready = F.col("_expected").isNotNull() & (F.col("_rows") == 1) & F.col("_ok")
    return both.agg(
        F.count("_expected").alias("expected"),
        F.count(F.when(F.coalesce(ready, F.lit(False)), 1)).alias("ready"),
        F.coalesce(F.bool_and(F.coalesce(ready, F.lit(False))), F.lit(False)).alias("complete"),
    )


def result_rows(outcomes: DataFrame) -> DataFrame:
    return outcomes.where(F.col("state") == "succeeded").select(
        *[F.col(f"classification.{name}").alias(name) for name in V.CLASSIFICATION_FIELDS]
    )


def export_results(outcomes: DataFrame, expected: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write all results in ID order, or nothing: an incomplete run is refused, as is an existing target."""
    if not exportable(outcomes, expected).first()["complete"]:
        raise ValueError("Every expected item must succeed before export.")
    rows = result_rows(outcomes).orderBy("id")
    rows.write.mode("overwrite" if overwrite else "errorifexists").option("ignoreNullFields", "false").json(path)


def run_report(parts: dict[str, DataFrame]) -> DataFrame:
    """Report parts as (section, body) rows with one JSON body per part row; no part becomes a single value."""
    rows = None
    for section, part in parts.items():
        body = F.to_json(F.struct(*part.columns), {"ignoreNullFields": "false"})
        entry = part.select(F.lit(section).alias("section"), body.alias("body"))
        rows = entry if rows is None else rows.unionByName(entry)
    return rows


def write_report(parts: dict[str, DataFrame], path: str, overwrite: bool = False) -> None:
    """One folder per section, each written in parallel by its own rows."""
    mode = "overwrite" if overwrite else "errorifexists"
    run_report(parts).write.mode(mode).partitionBy("section").text(path)
