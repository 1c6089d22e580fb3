import pandas as pd
from pyspark.sql import functions as F

from sluice.operators.classification import classify, masked_messages, pandas_scorer
from sluice.operators.rubric import rubric_labels

MESSAGES = [
    ("1", "El checkout muestra un error y cobra dos veces a los clientes, avisar a eva@x.com"),
    ("2", "Preciso do relatório de vendas para o gerente da loja em São Paulo hoje"),
    ("3", "hola"),
]


def _messages(spark):
    return spark.createDataFrame(MESSAGES, "id string, message string")


def test_labels_come_from_the_vocabulary(spark):
    found = {row.id: row for row in rubric_labels(_messages(spark)).collect()}
    assert (found["1"].categoria, found["1"].prioridad, found["1"].idioma) == ("bug", "alta", "es")
    assert (found["2"].categoria, found["2"].area_sugerida, found["2"].idioma) == ("datos", "data", "pt")
    assert (found["3"].categoria, found["3"].prioridad, found["3"].confianza) == ("otro", "media", 0.25)


def test_scorer_sees_masked_text_only(spark):
    assert masked_messages(_messages(spark)).columns == ["id", "masked_message"]
    seen = []

    def scorer(masked):
        seen.append((masked.columns, [row.masked_message for row in masked.orderBy("id").collect()]))
        from sluice.operators.rubric import rubric_answer
        return rubric_answer(masked)

    outcomes = {row.id: row for row in classify(_messages(spark), scorer, model="m", prompt_version="v7").collect()}
    assert seen[0][0] == ["id", "masked_message"] and "[EMAIL]" in seen[0][1][0] and "eva@" not in seen[0][1][0]
    assert all(row.state == "succeeded" and row.classification.version_prompt == "v7" for row in outcomes.values())
    assert outcomes["3"].classification.requiere_info and outcomes["3"].classification.pregunta_seguimiento
    assert {row.classification.id for row in outcomes.values()} == {"1", "2", "3"}


def test_language_policy_turns_results_into_failures(spark):
    def policy(summaries):
        return summaries.select("id", (F.col("id") != "2").alias("summary_accepted")).where("id != '3'")

    outcomes = {row.id: row for row in classify(_messages(spark), policy=policy).collect()}
    assert outcomes["1"].state == "succeeded"
    assert all(outcomes[i].failure_category == "invalid_summary_language" and outcomes[i].classification is None for i in "23")


def test_pandas_scorer_is_validated_like_any_other(spark):
    def load():
        def answer(texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame({
                "categoria": texts.str.contains("error").map({True: "bug", False: "nada"}), "prioridad": "alta", "area_sugerida": "data",
                "idioma": "es", "resumen": "x", "requiere_info": False, "pregunta_seguimiento": None, "confianza": 0.5,
            })

        return answer

    outcomes = {row.id: row for row in classify(_messages(spark), pandas_scorer(load, max_tasks=2)).collect()}
    assert outcomes["1"].classification.categoria == "bug"
    assert outcomes["2"].failure_category == outcomes["3"].failure_category == "invalid_classification"
