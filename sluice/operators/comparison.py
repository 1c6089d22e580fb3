"""Two scored runs side by side."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice import fixed_values as V
from sluice.operators.evaluation import score_join


def _wrong_fields(scored: DataFrame, side: str) -> DataFrame:
    fields = F.transform("mismatches", lambda entry: entry.getField("field"))
    return scored.select("id", fields.alias(f"{side}_wrong"), F.col("succeeded").alias(f"{side}_succeeded"))


def run_join(references: DataFrame, baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Per reference the wrong fields of both runs; every later comparison reads this one join."""
    before = _wrong_fields(score_join(references, baseline), "baseline")
    after = _wrong_fields(score_join(references, candidate), "candidate")
    return before.join(after, "id")


def _pairs(joined: DataFrame, minuend: str, subtrahend: str) -> DataFrame:
    fields = F.array_except(F.col(minuend), F.col(subtrahend))
    return joined.select("id", F.explode(fields).alias("field")).orderBy("id", "field")


def corrected(joined: DataFrame) -> DataFrame:
    return _pairs(joined, "baseline_wrong", "candidate_wrong")


def regressions(joined: DataFrame) -> DataFrame:
    return _pairs(joined, "candidate_wrong", "baseline_wrong")


def field_delta(joined: DataFrame) -> DataFrame:
    """Change in correct counts per field and over all fields."""

    def right(side: str, name: str) -> Column:
        fine = F.col(f"{side}_succeeded") & ~F.array_contains(F.col(f"{side}_wrong"), name)
        return F.count(F.when(fine, 1))

    deltas = joined.agg(
        *[(right("candidate", name) - right("baseline", name)).alias(name) for name in V.SCORED_FIELDS]
    )
    total = "+".join(V.SCORED_FIELDS)
    pairs = ", ".join(f"'{name}', {name}" for name in V.SCORED_FIELDS)
    return deltas.selectExpr(f"stack({len(V.SCORED_FIELDS) + 1}, {pairs}, 'overall', {total}) AS (field, delta)")


def compare(references: DataFrame, baseline: DataFrame, candidate: DataFrame) -> dict[str, DataFrame]:
    joined = run_join(references, baseline, candidate)
    return {
        "field_delta": field_delta(joined), "corrected": corrected(joined), "regressions": regressions(joined),
    }
