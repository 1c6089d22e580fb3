"""Scoring of a run's outcomes against reference labels.

References: ``id`` and the scored fields as ``ref_<field>``. Outcomes: ``id``, ``state``, ``failure_category``,
the scored fields and ``confianza``. Every reference stays in every denominator.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice import fixed_values as V
from sluice.sources.workspace import settle

BUCKETS, FEW_VALUES = 1 << 16, 50_000


def reference_columns(references: DataFrame) -> DataFrame:
    """Nested reference labels to the flat form used by the join."""
    return references.select("id", *[F.col(f"expected.{name}").alias(f"ref_{name}") for name in V.SCORED_FIELDS])


def outcome_columns(outcomes: DataFrame) -> DataFrame:
    """Nested outcomes to the flat form; labels only where the item succeeded."""
    done = F.col("state") == "succeeded"
    return outcomes.select(
        "id", "state", "failure_category",
        *[F.when(done, F.col(f"result.classification.{name}")).alias(name) for name in V.SCORED_FIELDS],
        F.when(done, F.col("result.classification.confianza")).alias("confianza"),
    )


def results_as_outcomes(results: DataFrame) -> DataFrame:
    """A flat result table read as outcomes that all succeeded."""
    return results.select(
        "id", F.lit("succeeded").alias("state"), F.lit(None).cast("string").alias("failure_category"),
        *V.SCORED_FIELDS, "confianza",
    )


def outcome_split(outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(succeeded, not succeeded)."""
    done = F.coalesce(F.col("state") == "succeeded", F.lit(False))
    return outcomes.where(done), outcomes.where(~done)


def _as_text(value: Column, name: str) -> Column:
    return value.cast("string") if name == "requiere_info" else value


def mismatch_array() -> Column:
    """Differences of a succeeded row as (field, expected, actual); empty for other states."""
    entries = F.array(*[
        F.struct(
            F.lit(name).alias("field"),
            _as_text(F.col(f"ref_{name}"), name).alias("expected"),
            _as_text(F.col(name), name).alias("actual"),
        )
        for name in V.SCORED_FIELDS
    ])
    wrong = F.filter(entries, lambda entry: ~entry.getField("expected").eqNullSafe(entry.getField("actual")))
    return F.when(F.col("succeeded"), wrong).otherwise(F.slice(entries, 1, 0))


def one_outcome_each(outcomes: DataFrame) -> DataFrame:
    """One row per ID with ``rows``, how many outcomes it was given; an ID that is given twice becomes one row here."""
    others = [name for name in outcomes.columns if name != "id"]
    reduced = outcomes.groupBy("id").agg(F.count("*").alias("rows"), F.min(F.struct(*others)).alias("_o"))
    return reduced.select("id", "rows", *[F.col(f"_o.{name}").alias(name) for name in others])


def score_join(references: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row per reference with state, mismatches and whether all fields are right.

    A reference with several outcomes has the state ``repeated`` and none of them counts.
    """
    joined = references.join(one_outcome_each(outcomes), "id", "left")
    joined = joined.withColumn("state", F.when(F.col("rows") > 1, "repeated").otherwise(F.coalesce("state", F.lit("missing")))).drop("rows")
    joined = joined.withColumn("succeeded", F.col("state") == "succeeded")
    exact = F.col("succeeded")
    for name in V.SCORED_FIELDS:
        exact = exact & F.col(f"ref_{name}").eqNullSafe(F.col(name))
    return joined.select("*", mismatch_array().alias("mismatches"), exact.alias("exact"))


def refused_outcomes(references: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(id, reason, rows) of outcomes that no score may use: ``repeated`` IDs and ``unexpected`` ones without a reference."""
    counted = outcomes.groupBy("id").agg(F.count("*").alias("rows"))
    known = references.select("id", F.lit(True).alias("_known"))
    joined = counted.join(known, "id", "left")
    reasons = F.array_compact(F.array(F.when(F.col("rows") > 1, "repeated"), F.when(F.col("_known").isNull(), "unexpected")))
    return joined.select("id", F.explode(reasons).alias("reason"), "rows")


def mismatch_unnest(scored: DataFrame) -> DataFrame:
    return scored.select("id", F.explode("mismatches").alias("m")).select("id", "m.field", "m.expected", "m.actual")


def _right(name: str) -> Column:
    right = F.col("succeeded") & F.col(f"ref_{name}").eqNullSafe(F.col(name))
    return F.count(F.when(right, 1))


def score_totals(scored: DataFrame) -> DataFrame:
    """All counts of the report in one aggregate over the joined rows."""
    return scored.agg(
        *[_right(name).alias(name) for name in V.SCORED_FIELDS],
        F.count(F.when(F.col("exact"), 1)).alias("all_five"),
        F.count("*").alias("total"),
    )


def field_accuracy(scored: DataFrame) -> DataFrame:
    pairs = ", ".join(f"'{name}', {name}" for name in V.SCORED_FIELDS)
    return (
        score_totals(scored)
        .selectExpr("total", f"stack({len(V.SCORED_FIELDS)}, {pairs}) AS (field, correct)")
        .select("field", "correct", "total", (F.col("correct") / F.col("total")).alias("accuracy"))
    )


def overall_accuracy(scored: DataFrame) -> DataFrame:
    right = F.col(V.SCORED_FIELDS[0])
    for name in V.SCORED_FIELDS[1:]:
        right = right + F.col(name)
    return (
        score_totals(scored)
        .select(right.alias("correct"), (F.col("total") * len(V.SCORED_FIELDS)).alias("total"))
        .withColumn("accuracy", F.col("correct") / F.col("total"))
    )


def all_five(scored: DataFrame) -> DataFrame:
    return score_totals(scored).select(
        F.col("all_five").alias("correct"), "total", (F.col("all_five") / F.col("total")).alias("accuracy")
    )


def exact_ids(scored: DataFrame) -> DataFrame:
    """IDs with every field right, as rows in ID order (never one collected list)."""
    return scored.where("exact").select("id").orderBy("id")


def failures(scored: DataFrame) -> DataFrame:
    category = F.when(
        F.col("state") == "failed", F.coalesce("failure_category", F.lit(V.DEFAULT_FAILURE_CATEGORY))
    )
    return scored.where(~F.col("succeeded")).select("id", "state", category.alias("category"))


def failure_counts(scored: DataFrame) -> DataFrame:
    return failures(scored).groupBy("state").agg(F.count("*").alias("failures"))


def failure_category_counts(scored: DataFrame) -> DataFrame:
    rows = failures(scored).where(F.col("category").isNotNull())
    return rows.groupBy("category").agg(F.count("*").alias("failures"))


def grouped_median(
    counted: DataFrame, group: str, value: str, count: str, buckets: int = BUCKETS, few: int = FEW_VALUES
) -> DataFrame:
    """Exact median per group from (group, value, count), one row for each different value.

    The range that holds the middle is cut into equal buckets, and the buckets that hold it are cut again, until at most
    ``few`` different values of a group are left; only those are put in order. So no window spans more rows than
    ``buckets`` or ``few``, however close together the values lie.
    """
    span = [F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count("*").alias("_values")]
    state = settle(counted.groupBy(group).agg(F.sum(count).alias("_all"), *span).withColumn("_before", F.lit(0).cast("long")))
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1

    def middle(rows: DataFrame) -> DataFrame:
        """Rows inside their group's range; the ranges are one row for each group."""
        return rows.join(state, group).where(F.col(value).between(F.col("_lo"), F.col("_hi")))

    while (state.agg(F.max("_values")).first()[0] or 0) > few:
        part = F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")) * buckets
        place = F.least(F.floor(F.coalesce(part, F.lit(0))), F.lit(buckets - 1)).alias("_bucket")
        cut = middle(counted).select(group, value, count, "_all", "_before", place)
        histogram = cut.groupBy(group, "_bucket", "_all", "_before").agg(F.sum(count).alias("_in"), *span)
        ordered = W.partitionBy(group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)
        ranked = histogram.withColumn("_upto", F.col("_before") + F.sum("_in").over(ordered))
        holding = ranked.where((F.col("_upto") >= low) & (F.col("_upto") - F.col("_in") < high))
        state = settle(
            holding.groupBy(group, "_all").agg(
                F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.sum("_values").alias("_values"), F.min(F.col("_upto") - F.col("_in")).alias("_before")
            )
        )
    inside = W.partitionBy(group).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    ranked = middle(counted).withColumn("_to", F.col("_before") + F.sum(count).over(inside))

    def holds(rank: Column) -> Column:
        return F.max(F.when((F.col("_to") >= rank) & (F.col("_to") - F.col(count) < rank), F.col(value)))

    return ranked.groupBy(group).agg(((holds(low) + holds(high)) / 2).alias("median"))


def confidence_stats(scored: DataFrame) -> DataFrame:
    """Count, mean and median of confidence for exact and for disagreeing rows; both groups always appear."""
    name = F.when(F.col("exact"), "exact").otherwise("disagreement")
    counted = (
        scored.where("succeeded").groupBy(name.alias("group"), "confianza").agg(F.count("*").alias("_n"))
    )
    means = counted.groupBy("group").agg(
        F.sum("_n").alias("count"), (F.sum(F.col("confianza") * F.col("_n")) / F.sum("_n")).alias("mean")
    )
    spine = scored.sparkSession.createDataFrame([("exact",), ("disagreement",)], "group string")
    return (
        spine.join(means, "group", "left")
        .join(grouped_median(counted, "group", "confianza", "_n"), "group", "left")
        .withColumn("count", F.coalesce("count", F.lit(0)))
    )


def lowest_confidence(scored: DataFrame, k: int | None = None) -> DataFrame:
    """Succeeded rows from the least certain; all of them unless a report asks for the first ``k``."""
    rows = scored.where("succeeded").select("id", F.col("confianza").alias("confidence")).orderBy("confidence", "id")
    return rows if k is None else rows.limit(k)


def highest_confidence_mistakes(scored: DataFrame, k: int | None = None) -> DataFrame:
    rows = (
        scored.where(F.col("succeeded") & ~F.col("exact"))
        .select("id", F.col("confianza").alias("confidence"))
        .orderBy(F.desc("confidence"), "id")
    )
    return rows if k is None else rows.limit(k)


def score(references: DataFrame, outcomes: DataFrame) -> dict[str, DataFrame]:
    """The whole score report as narrow DataFrames.

    References and outcomes are joined once and written down; every section reads that table. ``refused`` lists the
    outcomes that no section counts.
    """
    scored = settle(score_join(references, outcomes))
    return {
        "fields": field_accuracy(scored),
        "overall_exact_fields": overall_accuracy(scored),
        "all_five_fields": all_five(scored),
        "exact_message_ids": exact_ids(scored),
        "mismatches": mismatch_unnest(scored),
        "failures": failures(scored),
        "failure_counts": failure_counts(scored),
        "failure_category_counts": failure_category_counts(scored),
        "confidence": confidence_stats(scored),
        "lowest_successful": lowest_confidence(scored),
        "highest_confidence_mistakes": highest_confidence_mistakes(scored),
        "refused": refused_outcomes(references, outcomes),
    }


def missing_ids(expected: DataFrame, found: DataFrame) -> DataFrame:
    return expected.select("id").join(found.select("id"), "id", "left_anti")


def duplicate_ids(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id").agg(F.count("*").alias("rows")).where(F.col("rows") > 1)


def check_coverage(expected: DataFrame, found: DataFrame, texts: list[str]) -> DataFrame:
    """Per ID what is wrong with a fixture: absent, not expected, repeated, out of order or with empty text.

    ``expected`` and ``found`` carry ``position``. Counting before the join keeps a repeated ID cheap.
    """
    blank = F.lit(False)
    for name in texts:
        blank = blank | F.coalesce(F.col(name).rlike(r"(?U)^\s*$"), F.lit(True))
    seen = found.groupBy("id").agg(
        F.count("*").alias("_rows"), F.min("position").alias("_position"), F.max(blank).alias("_blank")
    )
    both = expected.select("id", F.col("position").alias("_expected")).join(seen, "id", "full_outer")
    flag = (
        F.when(F.col("_rows").isNull(), "missing")
        .when(F.col("_expected").isNull(), "unexpected")
        .when(F.col("_rows") > 1, "duplicate")
        .when(F.col("_blank"), "empty_text")
        .when(F.col("_position") != F.col("_expected"), "out_of_order")
        .otherwise("ok")
    )
    return both.select("id", flag.alias("status"))
