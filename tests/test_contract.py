from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sluice import schemas
from sluice.functions import contract as C
from sluice.functions import json_shape as J
from sluice.functions.money import backoff_delay, cost_expression, token_cost
from sluice.functions.text import word_count
from sluice.operators.classification import parse_answers

GOOD = {
    "categoria": "acceso", "prioridad": "baja", "area_sugerida": "devops", "idioma": "pt", "resumen": "Piden acceso al tablero",
    "requiere_info": True, "pregunta_seguimiento": "Qual tablero?", "confianza": 0.7, "id": "k-1", "version_prompt": "v2",
}
CASES = [
    ({}, []),
    ({"categoria": "queja"}, ["enum:categoria"]),
    ({"prioridad": None}, ["enum:prioridad"]),
    ({"area_sugerida": "legal", "idioma": "en"}, ["enum:area_sugerida", "enum:idioma"]),
    ({"resumen": ""}, ["summary_words"]),
    ({"resumen": " \t\n"}, ["summary_words"]),
    ({"resumen": "uno " * 21}, ["summary_words"]),
    ({"resumen": "\n" + "uno\t " * 20}, []),
    ({"requiere_info": True, "pregunta_seguimiento": None}, ["follow_up_required"]),
    ({"requiere_info": True, "pregunta_seguimiento": " \t"}, ["follow_up_required"]),
    ({"requiere_info": False, "pregunta_seguimiento": ""}, ["follow_up_forbidden"]),
    ({"requiere_info": False, "pregunta_seguimiento": "¿?"}, ["follow_up_forbidden"]),
    ({"requiere_info": False, "pregunta_seguimiento": None}, []),
    ({"confianza": -0.01}, ["confidence_range"]),
    ({"confianza": 1.01}, ["confidence_range"]),
    ({"confianza": float("nan")}, ["confidence_range"]),
    ({"confianza": float("inf")}, ["confidence_range"]),
    ({"confianza": 0.0}, []),
    ({"confianza": 1.0}, []),
    ({"id": " \n"}, ["blank:id"]),
    ({"version_prompt": ""}, ["blank:version_prompt"]),
]


def test_contract_cases(spark):
    rows = [(n, {**GOOD, **change}) for n, (change, _) in enumerate(CASES)]
    names = schemas.CLASSIFICATION.fieldNames()
    data = [(n, *[row[name] for name in names]) for n, row in rows]
    table = spark.createDataFrame(data, f"n int, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in schemas.CLASSIFICATION)}")
    found = {row.n: row.v for row in table.select("n", C.violations(C.classification_flags()).alias("v")).collect()}
    assert [found[n] for n in range(len(CASES))] == [expected for _, expected in CASES]


SHAPES = [
    ('{"id":"1","mensaje":"x"}', []),
    ('{"id":1,"mensaje":"x"}', ["type:id"]),
    ('{"id":"1"}', ["missing:mensaje"]),
    ('{"id":"1","mensaje":"x","a":1}', ["unknown:a"]),
    ('{"id":"1","mensaje":null}', ["type:mensaje"]),
    ('{"id":"1","mensaje":"x"} y', ["not_an_object"]),
    ("[1]", ["not_an_object"]),
    ("", ["not_an_object"]),
    (None, ["not_an_object"]),
]


def test_shapes_are_strict(spark):
    rows = spark.createDataFrame([(n, text) for n, (text, _) in enumerate(SHAPES)], "n int, t string")
    flags = J.shape_flags(F.col("t"), J.parse_strict(F.col("t")), J.SUBMISSION_TYPES).alias("v")
    found = {row.n: row.v for row in rows.select("n", flags).collect()}
    assert [found[n] for n in range(len(SHAPES))] == [expected for _, expected in SHAPES]


@pytest.mark.parametrize("value,bad", [("0", False), ("1", False), ("0.5", False), ("1e0", False), ("true", True), ('"0.5"', True), ("null", True)])
def test_confidence_takes_numbers_only(spark, value, bad):
    answer = (
        '{"categoria":"bug","prioridad":"alta","area_sugerida":"data","idioma":"es","resumen":"x","requiere_info":false,'
        f'"pregunta_seguimiento":null,"confianza":{value}}}'
    )
    row = parse_answers(spark.createDataFrame([(answer,)], "answer string")).first()
    assert row.shape_violations == (["type:confianza"] if bad else [])
    assert (row.confianza is None) == bad


def test_cost_cases(spark):
    calls = [
        (1, "a", 100, 20, 40), (2, "z", 100, 20, 0), (3, "a", None, None, None), (4, "b", 100, 20, 10), (5, "b", 100, 20, 0),
        (6, "a", 10, 20, 100), (7, "a", -1, 20, 0), (8, "m", 10699, 964, 0), (9, "b", 100, 20, None),
    ]
    prices = [("a", "1", "2", "0.5"), ("b", "1", "2", None), ("m", "0.40", "1.60", "0.10")]
    calls = spark.createDataFrame(calls, "n int, model string, input_tokens long, output_tokens long, cached_input_tokens long")
    prices = spark.createDataFrame(prices, "model string, i string, o string, c string").select(
        "model", *[F.col(short).cast("decimal(12,6)").alias(name) for short, name in
                   (("i", "input_per_million"), ("o", "output_per_million"), ("c", "cached_input_per_million"))]
    )
    found = {row.n: row.cost_usd for row in token_cost(calls, prices).collect()}
    assert {n: None if cost is None else f"{cost:f}" for n, cost in found.items()} == {
        1: "0.000120000000", 2: None, 3: None, 4: None, 5: "0.000140000000", 6: None, 7: None, 8: "0.005822000000",
        9: "0.000140000000",
    }


def test_delay_is_capped(spark):
    rows = spark.createDataFrame([(n,) for n in range(1, 5)], "attempt int")
    assert [row.d for row in rows.select(backoff_delay(F.col("attempt"), 2.0, 3.0).alias("d")).collect()] == [2.0, 3.0, 3.0, 3.0]


def test_words_are_split_at_any_whitespace(spark):
    rows = spark.createDataFrame([("a\tb\n c d e ",)], "t string")
    assert rows.select(word_count(F.col("t")).alias("n")).first().n == 5


def test_a_text_that_closes_the_wrapper_is_not_json(spark):
    texts = ['{"a":1}] x', '{"a":1}],["z"', "1],[2", '{"a":1}, "b":{"c":2}', '1}', '1,"s":1} x', '{"a":1} x', "1,2", "", " "]
    good = ['{"a":1}', "null", "[1,2]", '"x"', " 7 "]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts + good)], "k int, t string")
    read = rows.select("k", J.parse_strict(F.col("t")).isNull().alias("gone")).orderBy("k").collect()
    assert [r.gone for r in read] == [True] * len(texts) + [False] * len(good)


def test_cost_of_many_tokens_and_of_low_prices(spark):
    rows = spark.sql(
        "SELECT 2000000000000L AS g, 10L AS p, CAST(NULL AS BIGINT) AS c, 0.15BD AS i, 0.6BD AS o UNION ALL SELECT 1000000L, 1000000L, 0L, 0.00000049BD, 0.00000051BD"
        " UNION ALL SELECT 5L, 5L, 9L, 1BD, 1BD"
    )
    cost = cost_expression(F.col("g"), F.col("p"), F.col("c"), F.col("i"), F.col("o"), F.lit(None).cast("decimal(12,6)"))
    found = [r.cost for r in rows.select(cost.alias("cost")).collect()]
    assert found == [Decimal("300000.000006"), Decimal("0.000001"), None]
