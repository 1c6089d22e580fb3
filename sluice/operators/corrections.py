"""Human corrections folded over completed requests, with exact rejection of invalid ones.

A correction is judged against the record as it is at that moment, which looks sequential. It is not:
field values are valid or not by themselves, and the one cross-field rule (a question if and only if
information is missing) makes the record's relevant state a single bit. Only corrections that set both of
its fields change that bit, and those are valid or not by themselves. So whether a correction that sets
just one of them is accepted depends on the last such setter before it.

That lookup is a running ``last`` cut into ranges of (ID, time): ranges of equal size, whatever share of the
rows one ID holds, then the last setter per ID and range, a carry over an ID's ranges, and a window inside
each range. No ID's history is gathered in one place.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice import fixed_values as V
from sluice.functions.contract import DOMAINS, outside
from sluice.functions.json_shape import CONTENT_TYPES, parse_strict, shape_flags
from sluice.functions.text import is_blank, word_count
from sluice.operators.requests import effective_classification
from sluice.sources.workspace import settle

def has(name: str) -> Column:
    return F.col(f"has_{name}")


def parse_corrections(rows: DataFrame, changes: str = "changes") -> DataFrame:
    """JSON change sets to presence flags and values; absent and null stay apart."""
    parsed = rows.withColumn("_value", parse_strict(F.col(changes)))
    parsed = parsed.withColumn(
        "shape_violations", shape_flags(F.col(changes), F.col("_value"), CONTENT_TYPES, partial=True)
    )
    keys = F.coalesce(F.json_object_keys(changes), F.array().cast("array<string>"))
    columns = []
    for name in V.CONTENT_FIELDS:
        kind = "boolean" if name == "requiere_info" else "string"
        columns.append(F.array_contains(keys, name).alias(f"has_{name}"))
        columns.append(F.try_variant_get("_value", f"$.{name}", kind).alias(name))
    return parsed.select(*rows.columns, "shape_violations", *columns)


def own_reason() -> Column:
    """Why a change set is invalid whatever the record holds; null when nothing is wrong by itself."""
    anything = has(V.CONTENT_FIELDS[0])
    for name in V.CONTENT_FIELDS[1:]:
        anything = anything | has(name)
    bad_label = F.lit(False)
    for name, domain in DOMAINS.items():
        bad_label = bad_label | (has(name) & outside(F.col(name), domain))
    words = F.coalesce(word_count(F.col("resumen")), F.lit(0))
    needs, question = F.col("requiere_info"), F.col("pregunta_seguimiento")
    both = has("requiere_info") & has("pregunta_seguimiento")
    return (
        F.when(~anything, "empty")
        .when(has("resumen") & ~F.coalesce(F.col("summary_accepted"), F.lit(False)), "summary_language")
        .when(bad_label, "invalid_label")
        .when(has("resumen") & ~words.between(1, V.SUMMARY_MAX_WORDS), "summary_words")
        .when(has("requiere_info") & needs.isNull(), "invalid_label")
        .when(has("pregunta_seguimiento") & F.coalesce(is_blank(question), F.lit(False)), "follow_up")
        .when(both & (needs != question.isNotNull()), "follow_up")
    )


def judge_corrections(requests: DataFrame, corrections: DataFrame, ranges: int | None = None) -> DataFrame:
    """Corrections (id, ts, seq, has_*, values, optional summary_accepted) with ``reason``, null if accepted.

    (ts, seq) orders an ID's corrections without ties. ``ranges`` defaults to the shuffle partitions, so it
    follows the size the session is set up for.
    """
    ranges = ranges or int(corrections.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = corrections.columns
    if "summary_accepted" not in names:
        corrections = corrections.withColumn("summary_accepted", F.lit(True))
    own = own_reason()
    if "shape_violations" in names:
        own = F.when(F.size("shape_violations") > 0, "shape").otherwise(own)
    sets_needs, sets_question = has("requiere_info"), has("pregunta_seguimiento")
    sound = F.col("_own").isNull()
    wants = F.when(sets_needs, F.col("requiere_info")).otherwise(F.col("pregunta_seguimiento").isNotNull())
    # The range of a row is written down once: recomputed boundaries could differ between its two uses.
    ranged = settle(
        corrections.withColumn("_own", own)
        .select(
            *names, "_own",
            F.when(sound & sets_needs & sets_question, F.col("requiere_info")).alias("_bit"),
            F.when(sound & (sets_needs != sets_question), wants).alias("_wants"),
        )
        .repartitionByRange(ranges, "id", "ts", "seq")
        .withColumn("_range", F.spark_partition_id())
    )
    last_set = F.max(F.when(F.col("_bit").isNotNull(), F.struct("ts", "seq", "_bit")))
    earlier = W.partitionBy("id").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    originals = requests.select(
        "id", F.col("state").alias("_state"), effective_classification().getField("requiere_info").alias("_original")
    )
    # At most ``ranges`` rows per ID from here to the join back.
    carried = (
        ranged.groupBy("id", "_range")
        .agg(last_set.alias("_set"))
        .withColumn("_carry", F.last(F.col("_set._bit"), ignorenulls=True).over(earlier))
        .join(originals, "id", "left")
        .select("id", "_range", "_state", F.coalesce("_carry", "_original").alias("_before"))
    )
    inside = W.partitionBy("id", "_range").orderBy("ts", "seq").rowsBetween(W.unboundedPreceding, -1)
    judged = ranged.withColumn("_inside", F.last("_bit", ignorenulls=True).over(inside)).join(
        carried, ["id", "_range"], "left"
    )
    reason = (
        F.when(F.col("_own").isin("shape", "empty", "summary_language"), F.col("_own"))
        .when(F.col("_state").isNull(), "not_found")
        .when(F.col("_state") != "completed", "not_completed")
        .when(F.col("_own").isNotNull(), F.col("_own"))
        .when(F.col("_wants") != F.coalesce("_inside", "_before"), "follow_up")
    )
    return judged.select(*names, reason.alias("reason"))


def _last_accepted(name: str) -> Column:
    return F.max(F.when(F.col("reason").isNull() & has(name), F.struct("ts", "seq", name))).alias(f"_{name}")


def latest_fields(judged: DataFrame) -> DataFrame:
    """Per ID the last accepted value of each field, by one partial aggregate."""
    return judged.groupBy("id").agg(
        *[_last_accepted(name) for name in V.CONTENT_FIELDS],
        F.max(F.when(F.col("reason").isNull(), F.col("ts"))).alias("_corrected_at"),
        F.count(F.when(F.col("reason").isNull(), 1)).alias("_accepted"),
    )


def apply_latest(requests: DataFrame, latest: DataFrame) -> DataFrame:
    """Requests with correction, effective labels and times refreshed; the labelled result never changes."""
    joined = requests.join(latest, "id", "left").withColumn("_base", effective_classification())
    changed = F.coalesce(F.col("_accepted") > 0, F.lit(False))
    merged = F.struct(*[
        F.when(F.col(f"_{name}").isNotNull(), F.col(f"_{name}.{name}"))
        .otherwise(F.col(f"_base.{name}"))
        .alias(name)
        for name in V.CONTENT_FIELDS
    ])
    folded = joined.withColumn("human_correction", F.when(changed, merged).otherwise(F.col("human_correction")))
    for column, name in (
        ("effective_category", "categoria"), ("effective_priority", "prioridad"), ("effective_area", "area_sugerida"),
    ):
        folded = folded.withColumn(
            column, F.when(changed, F.col(f"human_correction.{name}")).otherwise(F.col(column))
        )
    at = F.col("_corrected_at").cast("timestamp")
    folded = folded.withColumn("corrected_at", F.when(changed, at).otherwise(F.col("corrected_at")))
    folded = folded.withColumn("updated_at", F.when(changed, at).otherwise(F.col("updated_at")))
    return folded.select(*requests.columns)


def with_policy(corrections: DataFrame, policy: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``corrections`` with ``summary_accepted``: the policy judges each different new summary once.

    ``policy`` maps (id, resumen) to (id, summary_accepted), as for a classification; ``id`` is the summary itself here.
    Corrections that leave the summary alone are accepted unseen.
    """
    texts = settle(corrections.where(has("resumen") & F.col("resumen").isNotNull()).select("resumen").distinct())
    verdict = policy(texts.select(F.col("resumen").alias("id"), "resumen")).select(F.col("id").alias("resumen"), F.col("summary_accepted").alias("_fine"))
    joined = corrections.join(verdict, "resumen", "left")
    accepted = F.when(has("resumen"), F.coalesce("_fine", F.lit(False))).otherwise(F.lit(True))
    return joined.select(*[name for name in corrections.columns if name != "summary_accepted"], accepted.alias("summary_accepted"))


def fold_corrections(
    requests: DataFrame, corrections: DataFrame, ranges: int | None = None, policy: Callable[[DataFrame], DataFrame] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(requests after all accepted corrections, rejected corrections with their reason).

    With ``policy`` (see ``with_policy``) a new summary in another language is rejected as ``summary_language``.
    """
    if policy is not None:
        corrections = with_policy(corrections, policy)
    judged = judge_corrections(requests, corrections, ranges)
    return apply_latest(requests, latest_fields(judged)), judged.where(F.col("reason").isNotNull())
