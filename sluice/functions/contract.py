"""Contract rules as Columns: each returns an array of violation names, empty when the row conforms."""

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice import fixed_values as V
from sluice.functions.text import flag_list, is_blank, word_count

Fields = Callable[[str], Column]
DOMAINS: Mapping[str, tuple[str, ...]] = {
    "categoria": V.CATEGORIES, "prioridad": V.PRIORITIES, "area_sugerida": V.AREAS, "idioma": V.LANGUAGES,
}


def outside(value: Column, domain) -> Column:
    """A missing value is outside every domain."""
    return ~F.coalesce(value.isin(*domain), F.lit(False))


def enum_flags(field: Fields = F.col) -> list[tuple[str, Column]]:
    return [(f"enum:{name}", outside(field(name), domain)) for name, domain in DOMAINS.items()]


def summary_flags(field: Fields = F.col, max_words: int = V.SUMMARY_MAX_WORDS) -> list[tuple[str, Column]]:
    return [("summary_words", ~F.coalesce(word_count(field("resumen")).between(1, max_words), F.lit(False)))]


def follow_up_flags(field: Fields = F.col) -> list[tuple[str, Column]]:
    needs, question = field("requiere_info"), field("pregunta_seguimiento")
    return [
        ("needs_info_missing", needs.isNull()),
        ("follow_up_required", needs & (question.isNull() | is_blank(question))),
        ("follow_up_forbidden", ~needs & question.isNotNull()),
    ]


def confidence_flags(field: Fields = F.col) -> list[tuple[str, Column]]:
    value = field("confianza")
    return [("confidence_range", ~F.coalesce(value.between(0, 1) & ~F.isnan(value), F.lit(False)))]


def identifier_flags(field: Fields = F.col) -> list[tuple[str, Column]]:
    return [(f"blank:{name}", F.coalesce(is_blank(field(name)), F.lit(True))) for name in ("id", "version_prompt")]


def content_flags(field: Fields = F.col) -> list[tuple[str, Column]]:
    return [*enum_flags(field), *summary_flags(field), *follow_up_flags(field)]


def classification_flags(field: Fields = F.col) -> list[tuple[str, Column]]:
    return [*content_flags(field), *confidence_flags(field), *identifier_flags(field)]


def usage_flags(field: Fields = F.col) -> list[tuple[str, Column]]:
    given, produced, cached = field("input_tokens"), field("output_tokens"), field("cached_input_tokens")
    return [
        ("usage_pair", given.isNull() != produced.isNull()),
        ("cached_without_input", cached.isNotNull() & given.isNull()),
        ("cached_exceeds_input", cached > given),
        ("negative_usage", F.least(given, produced, cached) < 0),
        ("attempt_range", F.coalesce(field("attempt") < 1, F.lit(True))),
        ("negative_latency", F.coalesce(field("latency_ms") < 0, F.lit(True))),
        ("negative_cost", field("estimated_cost_usd") < 0),
    ]


def provenance_flags(
    outcome_id: Column, classification_id: Column, version: Column, metadata_version: Column, run_version: Column
) -> list[tuple[str, Column]]:
    return [
        ("id_differs", ~outcome_id.eqNullSafe(classification_id)),
        ("metadata_version_differs", ~version.eqNullSafe(metadata_version)),
        ("run_version_differs", ~version.eqNullSafe(run_version)),
    ]


def request_state_flags(field: Fields = F.col) -> list[tuple[str, Column]]:
    """Cross-column rules of a stored request."""
    state = field("state")
    done = state == "completed"
    result, metadata = field("ai_classification"), field("provider_metadata")
    correction, failure = field("human_correction"), field("failure_code")
    effective = [field(name) for name in ("effective_category", "effective_priority", "effective_area")]
    effective_missing = effective[0].isNull() | effective[1].isNull() | effective[2].isNull()
    domains = (V.CATEGORIES, V.PRIORITIES, V.AREAS)
    bad_effective = [value.isNotNull() & ~value.isin(*domain) for value, domain in zip(effective, domains)]
    return [
        ("state_domain", outside(state, V.REQUEST_STATES)),
        ("effective_domain", bad_effective[0] | bad_effective[1] | bad_effective[2]),
        ("completed_without_result", done & (result.isNull() | metadata.isNull() | field("classified_at").isNull())),
        ("completed_without_effective", done & effective_missing),
        ("completed_with_failure", done & failure.isNotNull()),
        (
            "open_with_result",
            ~done
            & (result.isNotNull() | correction.isNotNull() | metadata.isNotNull() | field("classified_at").isNotNull()),
        ),
        ("correction_without_time", correction.isNotNull() & field("corrected_at").isNull()),
        ("failed_without_code", (state == "failed") & failure.isNull()),
        ("processing_with_code", (state == "processing") & failure.isNotNull()),
    ]


def failure_code_flags(field: Fields = F.col) -> list[tuple[str, Column]]:
    return [("failure_code", ~F.coalesce(field("failure_code").rlike(V.FAILURE_CODE), F.lit(False)))]


def outcome_state_flags(field: Fields = F.col) -> list[tuple[str, Column]]:
    return [("state_domain", outside(field("state"), V.OUTCOME_STATES))]


def pricing_flags(field: Fields = F.col) -> list[tuple[str, Column]]:
    given, produced = field("input_per_million"), field("output_per_million")
    cached = field("cached_input_per_million")
    return [
        ("price_pair", given.isNull() != produced.isNull()),
        ("cached_without_prices", cached.isNotNull() & (given.isNull() | produced.isNull())),
        ("negative_price", F.least(given, produced, cached) < 0),
    ]


def submission_flags(field: Fields = F.col) -> list[tuple[str, Column]]:
    return [
        ("blank:id", F.coalesce(is_blank(field("id")), F.lit(True))),
        ("blank:message", F.coalesce(is_blank(field("message")), F.lit(True))),
    ]


def violations(flags: list[tuple[str, Column]]) -> Column:
    return flag_list(*flags)


def conforms(flags: list[tuple[str, Column]]) -> Column:
    """No flag is true; a plain condition, where the names are not needed."""
    broken = F.lit(False)
    for _, condition in flags:
        broken = broken | F.coalesce(condition, F.lit(False))
    return ~broken


def split_valid(df: DataFrame, flags: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(conforming rows, quarantined rows with ``violations``)."""
    fine = conforms(flags)
    return df.where(fine), df.where(~fine).withColumn("violations", violations(flags))
