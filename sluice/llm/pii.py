"""Format-preserving pseudonyms of personal data, by keyed Feistel permutations, inside Spark's own expressions.

Numbers and dates are replaced only when they are valid (issuer, length and check digit, octets, areas, calendar). Each
becomes another valid value of its format, and equal values become equal pseudonyms in all documents:

* card numbers, bare or in their usual groups with one separator: the issuer's first digits stay, the others but the check
  digit are permuted, the check digit is set anew; separators stay
* IPv4 addresses: a permutation of 32-bit numbers
* dates: a permutation of the days of their 400-year cycle, in the same notation
* social security numbers: a permutation of the valid ones
* phone numbers (8 to 15 digits with a country code, or ten in the usual notations): the digits after the country code
* e-mail addresses: letters and digits are permuted among their kind, the last label of the domain stays
* hexadecimal secrets behind a word that says so (token, password, ...), and access key identifiers: digits and letters are
  permuted among their kind; a bare checksum or commit hash is no secret
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,8}"
IPV4 = rf"(?<![0-9.]){_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}(?![0-9]|\.[0-9])"
PHONE = (
    r"(?<![0-9+])\+[1-9][0-9]{0,2}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"
    r"|(?<![0-9(])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])"
)
SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"
DATE = r"(?<![0-9/-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9/-])"
SECRET = (
    r"(?<=(?i:token|secret|password|passwd|pwd|key|bearer)[\"']?[ ]{0,2}[:= ][ ]{0,2}[\"']?)(?:[0-9a-f]{16,128}|[0-9A-F]{16,128})(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"
)
#: The first four digits of 16-digit cards, of 15-digit and of 14-digit ones.
_FIRST_16 = r"(?:4[0-9]{3}|5[1-5][0-9]{2}|222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720|6011|65[0-9]{2}|64[4-9][0-9]|35(?:2[89]|[3-8][0-9])|62[0-9]{2})"
_FIRST_15, _FIRST_14 = r"3[47][0-9]{2}", r"3(?:0[0-5]|[68][0-9])[0-9]"


def _card_pattern() -> str:
    """Bare or in the usual groups; four-digit groups that go on on both sides are a table of numbers."""
    forms = [rf"{_FIRST_16}[0-9]{{12}}", rf"{_FIRST_15}[0-9]{{11}}", rf"{_FIRST_14}[0-9]{{10}}", r"4[0-9]{12}(?:[0-9]{6})?"]
    for mark in " -":
        forms.append(rf"(?:4[0-9]{{3}}|62[0-9]{{2}})(?:{mark}[0-9]{{4}}){{3}}{mark}[0-9]{{3}}(?![0-9])")
        forms.append(rf"(?:(?<![0-9]{{4}}{mark})|(?!.{{19}}{mark}[0-9]{{4}}(?![0-9]))){_FIRST_16}(?:{mark}[0-9]{{4}}){{3}}")
        forms += [rf"{_FIRST_15}{mark}[0-9]{{6}}{mark}[0-9]{{5}}", rf"{_FIRST_14}{mark}[0-9]{{6}}{mark}[0-9]{{4}}"]
    return rf"(?<![A-Za-z0-9.])(?:{'|'.join(forms)})(?![A-Za-z0-9]|\.[0-9])"


CARD = _card_pattern()
#: Longer readings first where two begin at one place.
PATTERN = "|".join((EMAIL, SECRET, IPV4, PHONE, DATE, SSN, CARD))
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _secret_number(key: str, *parts: Column) -> Column:
    """A keyed 60-bit number of the parts."""
    told = F.sha2(F.concat_ws("\u0001", F.lit(key), *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(told, 1, 15), 16, 10).cast("long")


def feistel_text(value: Column, key: str, kind: str, letters: int = 26) -> Column:
    """Letters and digits of a text permuted among their kind: each half is shifted by what the other one holds.

    ``letters`` is how many letters of the alphabet a letter may become. Texts of one character are only shifted.
    """

    def turn(text: Column, number: Column) -> Column:
        size, half = F.length(text), F.floor(F.length(text) / 2).cast("int")
        first = number % 2 == 0
        fixed = F.when(first, F.substr(text, half + 1)).otherwise(F.substr(text, F.lit(1), half))
        moved = F.when(first, F.substr(text, F.lit(1), half)).otherwise(F.substr(text, half + 1))

        def shifted(told: Column) -> Column:
            def one(place: Column) -> Column:
                sign = F.substr(moved, place, F.lit(1))
                by = F.pmod(F.xxhash64(told, place), F.lit(1 << 30))
                out = sign
                for alphabet in (_UPPER[:letters], _LOWER[:letters], _DIGITS):
                    at = F.position(sign, F.lit(alphabet))
                    there = F.pmod(at - 1 + by, F.lit(len(alphabet))).cast("int") + 1
                    out = F.when(at > 0, F.substr(F.lit(alphabet), there, F.lit(1))).otherwise(out)
                return out

            return F.array_join(F.transform(F.sequence(F.lit(1), F.length(moved)), one), "")

        new = F.when(F.length(moved) > 0, _let(_secret_number(key, F.lit(kind), number, fixed), shifted)).otherwise(moved)
        return F.when(size == 0, text).when(first, F.concat(new, fixed)).otherwise(F.concat(fixed, new))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), value, turn)


def feistel_pair(left: Column, right: Column, left_size: int, right_size: int, key: str, kind: str) -> Column:
    """A permutation of pairs (left below ``left_size``, right below ``right_size``), as a struct of both."""

    def turn(pair: Column, number: Column) -> Column:
        first = number % 2 == 0
        by = _secret_number(key, F.lit(kind), number, F.when(first, pair["right"]).otherwise(pair["left"]))
        return F.struct(
            F.when(first, F.pmod(pair["left"] + by, F.lit(left_size))).otherwise(pair["left"]).cast("long").alias("left"),
            F.when(first, pair["right"]).otherwise(F.pmod(pair["right"] + by, F.lit(right_size))).cast("long").alias("right"),
        )

    start = F.struct(left.cast("long").alias("left"), right.cast("long").alias("right"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn_sum(digits: Column) -> Column:
    """The sum of a digit text in which the last digit counts double."""

    def add(total: Column, place: Column) -> Column:
        digit = F.substr(digits, F.length(digits) - place, F.lit(1)).cast("int")
        double = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(place % 2 == 0, double).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def _check_digit(payload: Column) -> Column:
    return F.pmod(F.lit(10) - _luhn_sum(payload) % 10, F.lit(10))


def _laid_out(pattern: Column, digits: Column) -> Column:
    """The digits in the places of the pattern's digits."""

    def put(out: Column, sign: Column) -> Column:
        number = sign.rlike("^[0-9]$")
        return F.struct(
            F.concat(out["text"], F.when(number, F.substr(digits, out["next"], F.lit(1))).otherwise(sign)).alias("text"),
            F.when(number, out["next"] + 1).otherwise(out["next"]).alias("next"),
        )

    start = F.struct(F.lit("").alias("text"), F.lit(1).alias("next"))
    return F.aggregate(F.split(pattern, ""), start, put)["text"]


def _card(value: Column, key: str) -> Column:
    """The pseudonym of a card with the right check digit, under the same issuer; other numbers stay."""

    def changed(digits: Column) -> Column:
        head = F.substr(digits, F.lit(1), F.lit(4))
        rest = F.substr(digits, F.lit(5), F.length(digits) - 5)
        made = _let(F.concat(head, feistel_text(rest, key, "card")), lambda p: F.concat(p, _check_digit(p).cast("string")))
        payload = F.substr(digits, F.lit(1), F.length(digits) - 1)
        valid = _check_digit(payload) == F.substr(digits, F.length(digits)).cast("int")
        return F.when(valid, _laid_out(value, made)).otherwise(value)

    return _let(_digits(value), changed)


def _grouped_card(value: Column, key: str) -> Column:
    """A card of 19 digits, or one of 16 with three other digits behind it."""
    return _let(_card(value, key), lambda whole: F.when((whole != value) | ~value.rlike("^(?:[0-9]{4}[ -]){4}[0-9]{3}$"), whole).otherwise(
        F.concat(_card(F.substr(value, F.lit(1), F.lit(19)), key), F.substr(value, F.lit(20)))
    ))


def _ssn(value: Column, key: str) -> Column:
    """A permutation of the valid numbers: areas 001 to 899 without 666, groups from 01, serials from 0001."""
    part = F.transform(F.split(value, "-"), lambda x: x.cast("long"))

    def changed(p: Column) -> Column:
        area = p[0] - F.when(p[0] > 666, 2).otherwise(1)
        pair = feistel_pair(area * 99 + p[1] - 1, p[2] - 1, 898 * 99, 9999, key, "ssn")

        def told(x: Column) -> Column:
            place = F.floor(x["left"] / 99)
            made = (place + F.when(place >= 665, 2).otherwise(1), x["left"] % 99 + 1, x["right"] + 1)
            return F.concat_ws("-", *[F.lpad(n.cast("string"), width, "0") for n, width in zip(made, (3, 2, 4))])

        return _let(pair, told)

    return _let(part, changed)


def _secret(value: Column, key: str) -> Column:
    identifier = value.rlike("^AKIA[A-Z0-9]{16}$")
    moved = F.when(identifier, feistel_text(F.substr(value, F.lit(5)), key, "access")).otherwise(feistel_text(value, key, "secret", 6))
    return F.when(identifier, F.concat(F.lit("AKIA"), moved)).otherwise(moved)


def _ipv4(value: Column, key: str) -> Column:
    part = F.transform(F.split(value, r"\."), lambda x: x.cast("long"))

    def changed(p: Column) -> Column:
        pair = feistel_pair(p[0] * 256 + p[1], p[2] * 256 + p[3], 1 << 16, 1 << 16, key, "ipv4")
        return _let(pair, lambda x: F.concat_ws(".", *[(F.floor(x[side] / 256) if high else x[side] % 256).cast("string") for side in ("left", "right") for high in (True, False)]))

    return _let(part, changed)


def _date(value: Column, key: str) -> Column:
    """Year first, or day first, or month first where only that is a date."""
    forms = ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy")
    cycle, left, right = 146_097, 189, 773  # days of 400 years, and two factors of them

    def changed(days: Column, form: str) -> Column:
        place = F.pmod(days, F.lit(cycle))
        pair = feistel_pair(F.floor(place / right), place % right, left, right, key, "date")
        return F.date_format(F.date_add(F.to_date(F.lit("1970-01-01")), (days - place + pair["left"] * right + pair["right"]).cast("int")), form)

    out = value
    for form, shape in reversed(list(zip(forms, ("^[0-9]{4}-", "^[0-9]{2}/", "^[0-9]{2}/")))):
        day = F.datediff(F.to_date(F.try_to_timestamp(value, F.lit(form))), F.to_date(F.lit("1970-01-01")))
        out = F.when(value.rlike(shape) & day.isNotNull(), changed(day, form)).otherwise(out)
    return out


def _phone(value: Column, key: str) -> Column:
    code = F.when(value.startswith("+"), F.regexp_extract(value, r"^(\+[1-9][0-9]{0,2})(?=[ .(-])", 1)).otherwise("")
    code = F.when(value.startswith("+") & (code == ""), F.substring(value, 1, 2)).otherwise(code)
    rest = F.substr(value, F.length(code) + 1)
    return F.concat(code, _laid_out(rest, feistel_text(_digits(rest), key, "phone")))


def _email(value: Column, key: str) -> Column:
    kept = F.regexp_extract(value, r"(\.[A-Za-z0-9-]+)$", 1)
    return F.concat(feistel_text(F.substr(value, F.lit(1), F.length(value) - F.length(kept)), key, "email"), kept)


def _shape(pattern: str) -> str:
    """The pattern for a value on its own, without what has to stand around it."""
    return rf"^(?:{pattern})$"


def _replaced(value: Column, key: str) -> Column:
    """One match of ``PATTERN`` with its pseudonym."""
    secret = r"^(?:[0-9a-f]{16,128}|[0-9A-F]{16,128}|AKIA[A-Z0-9]{16})$"
    out = F.when(value.rlike(_shape(CARD)), _grouped_card(value, key)).when(value.rlike(secret), _secret(value, key)).otherwise(value)
    for pattern, new in ((DATE, _date(value, key)), (PHONE, _phone(value, key)), (SSN, _ssn(value, key)), (IPV4, _ipv4(value, key))):
        out = F.when(value.rlike(_shape(pattern)), new).otherwise(out)
    return F.when(value.contains("@"), _email(value, key)).otherwise(out)


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one match of ``PATTERN``; an invalid value stays."""
    return _replaced(value, key)


def pseudonymised(docs: DataFrame, key: str, text_column: str = "text", count_column: str | None = None) -> DataFrame:
    """``docs`` with personal data in ``text_column`` replaced; ``count_column``, if named, gets the values replaced.

    Null stays null (count 0) and an empty text empty; all rows, repeated ones too, and all other columns are kept as they
    are, an empty table stays empty. Texts without ``@`` or a digit are not searched; the time of the others grows with
    their length and their values. A local part of more than 64 characters is no address. Equal values get equal
    pseudonyms under one ``key``, which the caller keeps secret. A ``count_column`` that ``docs`` has already is refused.
    """
    if count_column in docs.columns:
        raise ValueError(f"{count_column!r} is a column already.")
    text = F.col(text_column)
    found, gaps = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), F.split(text, PATTERN, -1)
    pairs = F.transform(found, lambda value: F.struct(value.alias("old"), _replaced(value, key).alias("new")))

    def rebuilt(parts: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), F.size(parts["pairs"])), lambda k: F.concat(F.get(parts["gaps"], k), F.coalesce(F.get(parts["pairs"], k)["new"], F.lit(""))))
        changed = F.filter(parts["pairs"], lambda p: p["old"] != p["new"])
        return F.struct(F.array_join(pieces, "").alias("text"), F.size(changed).alias("count"))

    searched = F.when(text.rlike("[0-9@]"), _let(F.struct(gaps.alias("gaps"), pairs.alias("pairs")), rebuilt))
    helper = "_searched"
    while helper in docs.columns:
        helper += "_"
    marked = docs.withColumn(helper, searched)
    columns = [F.coalesce(F.col(f"{helper}.text"), text).alias(c) if c == text_column else F.col(f"`{c}`") for c in docs.columns]
    if count_column:
        columns.append(F.coalesce(F.col(f"{helper}.count"), F.lit(0)).alias(count_column))
    return marked.select(*columns)
