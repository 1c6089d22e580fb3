"""Masking."""

from pyspark.sql import functions as F

from sluice import fixed_values as V
from sluice.functions import masking as M
from sluice.plans.bindings import bind, bind_spread
from sluice.plans.catalog import query

LEFT, RIGHT = "(^|[^A-Za-z0-9])", "([^A-Za-z0-9]|$)"
GAP = r"(?:\s+|\s*[:#-]\s*)"


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def _edged(text: str, pattern: str, placeholder: str) -> str:
    """Replace between kept separators; twice, since neighbours may share one."""
    once = f"regexp_replace({text}, '{LEFT}{_quoted(pattern)}{RIGHT}', '\\1[{placeholder}]\\2', 'g')"
    return f"regexp_replace({once}, '{LEFT}{_quoted(pattern)}{RIGHT}', '\\1[{placeholder}]\\2', 'g')"


# Written out beside the operator's own pattern, so that a wrong one shows.
EMAIL_BODY = (
    r"[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
    r"(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+"
)


def email_sql(text: str) -> str:
    return f"regexp_replace({text}, '{_quoted(EMAIL_BODY)}([^A-Za-z0-9_%+-]|$)', '[EMAIL]\\1', 'g')"


def cnpj_valid_sql(digits: str) -> str:
    def check(weights, position):
        terms = " + ".join(f"CAST(substr({digits}, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate(weights))
        return (
            f"CASE WHEN ({terms}) % 11 < 2 THEN 0 ELSE 11 - ({terms}) % 11 END"
            f" = CAST(substr({digits}, {position}, 1) AS INT)"
        )

    return (
        f"({digits} <> repeat(substr({digits}, 1, 1), 14)"
        f" AND {check(V.CNPJ_WEIGHTS_FIRST, 13)} AND {check(V.CNPJ_WEIGHTS_SECOND, 14)})"
    )


def cnpj_sql(text: str) -> str:
    formatted = _edged(text, V.CNPJ_FORMATTED, "CNPJ")
    return f"regexp_replace({formatted}, '((?i:\\bCNPJ){GAP})[0-9]{{14}}{RIGHT}', '\\1[CNPJ]\\2', 'g')"


def bare_cnpj_sql(text: str) -> str:
    """Texts hold at most one bare 14-digit run here."""
    run = f"regexp_extract({text}, '{LEFT}([0-9]{{14}}){RIGHT}', 2)"
    return f"CASE WHEN {run} <> '' AND {cnpj_valid_sql(run)} THEN replace({text}, {run}, '[CNPJ]') ELSE {text} END"


def rfc_sql(text: str) -> str:
    return _edged(text, f"(?i:{V.RFC})", "RFC")


def country_sql(text: str) -> str:
    return _edged(text, V.COUNTRY_PHONE, "PHONE")


def local_sql(text: str) -> str:
    """Numbers after a reference word are set aside between letters, so the phone pattern passes them by."""
    aside = (
        f"regexp_replace({text}, '((?i:\\b{V.REFERENCE_WORD}){GAP})({V.LOCAL_PHONE}){RIGHT}', '\\1QZQ\\2QZQ\\3', 'g')"
    )
    return f"replace({_edged(aside, V.LOCAL_PHONE, 'PHONE')}, 'QZQ', '')"


def bare_sql(text: str) -> str:
    return f"regexp_replace({text}, '((?i:\\b{V.PHONE_WORD}){GAP}){V.BARE_PHONE}{RIGHT}', '\\1[PHONE]\\2', 'g')"


def masked_ctes(source: str, text: str, columns: str) -> str:
    """The full mask as CTEs m1..m7, each one step; ``masked`` is the last column."""
    steps = (email_sql, cnpj_sql, bare_cnpj_sql, rfc_sql, country_sql, local_sql, bare_sql)
    parts = [f"m0 AS (SELECT {columns}, {text} AS masked FROM {source})"]
    parts += [
        f"m{n} AS (SELECT {columns}, {step('masked')} AS masked FROM m{n - 1})" for n, step in enumerate(steps, 1)
    ]
    return ", ".join(parts)


def _masked_with(step):
    return lambda spark, sf_dir: bind_spread(spark, sf_dir, "texts").select("id", step(F.col("text")).alias("masked"))


query("mask_email", f"SELECT id, {email_sql('text')} AS masked FROM {{texts}}")(_masked_with(M.mask_email))
query(
    "mask_cnpj",
    f"WITH c AS (SELECT id, {cnpj_sql('text')} AS t FROM {{texts}}) SELECT id, {bare_cnpj_sql('t')} AS masked FROM c",
)(_masked_with(M.mask_cnpj))
query("mask_rfc", f"SELECT id, {rfc_sql('text')} AS masked FROM {{texts}}")(_masked_with(M.mask_rfc))
query("mask_country_phone", f"SELECT id, {country_sql('text')} AS masked FROM {{texts}}")(
    _masked_with(M.mask_country_phone)
)
query("mask_local_phone", f"SELECT id, {local_sql('text')} AS masked FROM {{texts}}")(_masked_with(M.mask_local_phone))
query("mask_bare_phone", f"SELECT id, {bare_sql('text')} AS masked FROM {{texts}}")(_masked_with(M.mask_bare_phone))
query("mask_pii", f"WITH {masked_ctes('{texts}', 'text', 'id')} SELECT id, masked FROM m7")(_masked_with(M.mask_pii))


def _behind(word: str, before: str) -> str:
    return f"regexp_matches(right({before}, 24), '(?i)\\b{_quoted(word)}\\s*[:#-]?\\s*$')"


@query(
    "mask_context",
    f"SELECT id, CASE WHEN kind = 'cnpj' AND ({cnpj_valid_sql('number')} OR " + _behind("CNPJ", "before") + ") THEN concat(before, '[CNPJ] fin')"
    " WHEN kind = 'bare' AND " + _behind(V.PHONE_WORD, "before") + " THEN concat(before, '[PHONE] fin')"
    " WHEN kind = 'local' AND NOT " + _behind(V.REFERENCE_WORD, "before") + " THEN concat(before, '[PHONE] fin') ELSE concat(before, number, ' fin') END AS masked FROM {spaced_numbers}",
)
def mask_context(spark, sf_dir):
    """Numbers at every distance from the word that decides about them, the word cut by the window included."""
    rows = bind_spread(spark, sf_dir, "spaced_numbers").withColumn("text", F.concat("before", "number", F.lit(" fin")))
    return rows.select("id", M.mask_pii(F.col("text")).alias("masked"))


@query(
    "mask_summary",
    f"WITH {masked_ctes('{documents}', 'text', 'lang, source, text')} "
    "SELECT lang, source, count(*) AS documents, count(CASE WHEN masked <> text THEN 1 END) AS changed, "
    "CAST(sum(len(masked) - len(replace(masked, '[PHONE]', '[PHONE'))) AS BIGINT) AS phones FROM m7 GROUP BY lang, source",
)
def mask_summary(spark, sf_dir):
    """Documents changed by masking, and phones masked, per language and source."""
    masked = bind_spread(spark, sf_dir, "documents").select("lang", "source", "text", M.mask_pii(F.col("text")).alias("masked"))
    phones = F.length("masked") - F.length(F.replace(F.col("masked"), F.lit("[PHONE]"), F.lit("[PHONE")))
    return masked.groupBy("lang", "source").agg(
        F.count("*").alias("documents"),
        F.count(F.when(F.col("masked") != F.col("text"), 1)).alias("changed"),
        F.sum(phones).alias("phones"),
    )


@query("cnpj_valid", f"SELECT id, digits, {cnpj_valid_sql('digits')} AS valid FROM {{bare_numbers}}")
def cnpj_valid(spark, sf_dir):
    return bind(spark, sf_dir, "bare_numbers").select("id", "digits", M.cnpj_valid(F.col("digits")).alias("valid"))
