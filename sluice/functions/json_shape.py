"""Strict JSON shape checks: the JSON type is looked at before any cast, since casts coerce."""

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice import fixed_values as V

# JSON types by the names variants give them.
STRING, BOOLEAN, NULL, OBJECT = ("STRING",), ("BOOLEAN",), ("VOID",), ("OBJECT",)
INTEGER = ("BIGINT",)
NUMBER = ("BIGINT", "DECIMAL", "DOUBLE")

# Which JSON types each field may hold.
CONTENT_TYPES: Mapping[str, tuple[str, ...]] = {
    "categoria": STRING, "prioridad": STRING, "area_sugerida": STRING, "idioma": STRING, "resumen": STRING,
    "requiere_info": BOOLEAN, "pregunta_seguimiento": STRING + NULL,
}
ANSWER_TYPES: Mapping[str, tuple[str, ...]] = {**CONTENT_TYPES, "confianza": NUMBER}
CLASSIFICATION_TYPES: Mapping[str, tuple[str, ...]] = {**ANSWER_TYPES, "id": STRING, "version_prompt": STRING}
SUBMISSION_TYPES: Mapping[str, tuple[str, ...]] = {"id": STRING, "mensaje": STRING}


def parse_strict(text: Column) -> Column:
    """The one JSON value in the text as a variant; null for anything else, trailing characters included.

    A lenient parser stops after the first value. The text must be whole in two wrappers: a one-element array, and an
    object with a member after it. A text that closes the one early breaks the other.
    """
    alone = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    followed = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit(',"s":1}')))
    whole = F.try_variant_get(alone, "$[1]", "variant").isNull() & (F.try_variant_get(followed, "$.s", "int") == 1)
    return F.when(whole, F.try_variant_get(alone, "$[0]", "variant"))


def json_type(value: Column) -> Column:
    """Type name of a variant without its parameters; null where the key is absent."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def field_type(value: Column, name: str) -> Column:
    return json_type(F.try_variant_get(value, f"$.{name}", "variant"))


def shape_flags(text: Column, value: Column, types: Mapping[str, tuple[str, ...]], partial: bool = False) -> Column:
    """Violations of a closed object shape: not an object, missing keys, unknown keys, wrong JSON types.

    ``partial`` allows keys to be absent but not all of them.
    """
    names = F.array(*[F.lit(name) for name in types])
    keys = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    # An absent key has no type; the comparison is null then and flags nothing.
    wrong = [F.when(~field_type(value, name).isin(*allowed), F.lit(f"type:{name}")) for name, allowed in types.items()]
    parts = [
        F.transform(F.array_sort(F.array_except(keys, names)), lambda key: F.concat(F.lit("unknown:"), key)),
        F.filter(F.array(*wrong), lambda flag: flag.isNotNull()),
    ]
    if partial:
        parts.insert(0, F.filter(F.array(F.when(F.size(keys) == 0, F.lit("empty"))), lambda flag: flag.isNotNull()))
    else:
        parts.insert(
            0, F.transform(F.array_except(names, keys), lambda key: F.concat(F.lit("missing:"), key))
        )
    is_object = F.coalesce(json_type(value).isin(*OBJECT), F.lit(False))
    return F.when(is_object, F.concat(*parts)).otherwise(F.array(F.lit("not_an_object")))


def unknown_keys(text: Column, allowed=V.CONTENT_FIELDS) -> Column:
    """Keys of a JSON object that are not allowed, sorted."""
    return F.array_sort(F.array_except(F.json_object_keys(text), F.array(*[F.lit(name) for name in allowed])))
