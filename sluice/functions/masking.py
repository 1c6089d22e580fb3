"""Personal identifiers to placeholders, as Column expressions only (no Python worker).

The steps run in a fixed order: email, company number, tax ID, country-code phone, local phone, bare phone.
A word before a number changes its meaning ("pedido 55 1234 5678" is no phone). Where that matters the text is taken apart
into numbers and what lies between them, and each number is judged by exactly the ``CONTEXT`` characters before it.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice import fixed_values as V

SPACE = r"[\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def _ends_with(word: str) -> str:
    """The word at the end of a stretch, with at most a mark and spaces behind it."""
    return rf"(?iu)(?<![\p{{L}}\p{{N}}_]){word}{SPACE}*[:#-]?{SPACE}*\z"


def _bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, which may read it several times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _replace_where(text: Column, sign: str, pattern: str, placeholder: str) -> Column:
    """Replace only in texts that show a cheap necessary sign of the pattern; most texts stop there."""
    return _bind(
        text,
        lambda current: F.when(current.rlike(sign), F.regexp_replace(current, pattern, placeholder)).otherwise(current),
    )


def _found(number: str) -> str:
    """A number between edges."""
    return f"{V.LEFT_EDGE}(?:{number}){V.RIGHT_EDGE}"


def _judge_each(text: Column, sign: str, pattern: str, placeholder: str, masked) -> Column:
    """Every match in its turn: replaced where ``masked(match, characters before it)`` holds.

    The characters before a match are those of the text as it is, earlier matches included. They reach at most over the
    three matches before, as a match has ten characters at least. All steps are by index, so the time grows with the text.
    """

    def apart(current: Column) -> Column:
        parts = F.struct(F.regexp_extract_all(current, F.lit(pattern), F.lit(0)).alias("found"), F.split(current, pattern, -1).alias("gaps"))

        def rebuilt(parts: Column) -> Column:
            def piece(place: Column) -> Column:
                def tail(name: str, back: int) -> Column:
                    value = F.coalesce(F.get(parts[name], place - back), F.lit(""))
                    return F.substring(value, -V.CONTEXT, V.CONTEXT)

                near = [part for back in (3, 2, 1) for part in (tail("found", back), tail("gaps", back - 1))]
                before = F.substring(F.concat(*near), -V.CONTEXT, V.CONTEXT)
                match = F.get(parts["found"], place)
                new = F.when(match.isNotNull() & masked(match, before), F.lit(placeholder)).otherwise(match)
                return F.concat(F.get(parts["gaps"], place), F.coalesce(new, F.lit("")))

            return F.array_join(F.transform(F.sequence(F.lit(0), F.size(parts["found"])), piece), "")

        return F.when(current.rlike(sign) & current.rlike(pattern), _bind(parts, rebuilt)).otherwise(current)

    return _bind(text, apart)


def mask_email(text: Column) -> Column:
    return _replace_where(text, "@", V.EMAIL, "[EMAIL]")


def cnpj_valid(digits: Column) -> Column:
    """Check digits of a 14-digit run; a run of one repeated digit is never valid."""

    def weighted(weights):
        terms = [F.substring(digits, position + 1, 1).try_cast("int") * weight for position, weight in enumerate(weights)]
        total = terms[0]
        for term in terms[1:]:
            total = total + term
        rest = total % 11
        return F.when(rest < 2, F.lit(0)).otherwise(11 - rest)

    valid = (
        digits.rlike("^[0-9]{14}$")
        & ~digits.rlike(r"^([0-9])\1{13}$")
        & (weighted(V.CNPJ_WEIGHTS_FIRST) == F.substring(digits, 13, 1).try_cast("int"))
        & (weighted(V.CNPJ_WEIGHTS_SECOND) == F.substring(digits, 14, 1).try_cast("int"))
    )
    return F.coalesce(valid, F.lit(False))


def mask_cnpj(text: Column) -> Column:
    """Formatted numbers always; bare ones with valid check digits or behind their name."""
    named = _ends_with(V.CNPJ_WORD)
    masked = lambda match, before: match.contains(".") | cnpj_valid(match) | before.rlike(named)
    return _judge_each(text, r"[0-9]{14}|[0-9]\.[0-9]{3}/", _found(f"{V.CNPJ_FORMATTED}|{V.CNPJ_BARE}"), "[CNPJ]", masked)


def mask_rfc(text: Column) -> Column:
    return _replace_where(text, "[0-9]{6}", f"{V.LEFT_EDGE}(?iu:{V.RFC}){V.RIGHT_EDGE}", "[RFC]")


def mask_country_phone(text: Column) -> Column:
    return _replace_where(text, r"\+5[25]", _found(V.COUNTRY_PHONE), "[PHONE]")


def mask_local_phone(text: Column) -> Column:
    named = _ends_with(V.REFERENCE_WORD)
    return _judge_each(text, "[0-9]{4}", _found(V.LOCAL_PHONE), "[PHONE]", lambda match, before: ~before.rlike(named))


def mask_bare_phone(text: Column) -> Column:
    named = _ends_with(V.PHONE_WORD)
    return _judge_each(text, "[0-9]{10}", _found(V.BARE_PHONE), "[PHONE]", lambda match, before: before.rlike(named))


MASK_STEPS = (mask_email, mask_cnpj, mask_rfc, mask_country_phone, mask_local_phone, mask_bare_phone)


def mask_pii(text: Column) -> Column:
    for step in MASK_STEPS:
        text = step(text)
    return text
