"""A vocabulary scorer: labels from the words of a masked message, as one narrow projection."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice import fixed_values as V

# ---- Fixed values: vocabulary of the rubric, word -> weight by dimension and label -------------
LEXICON: dict[str, dict[str, dict[str, int]]] = {
    "categoria": {
        "bug": {"error": 3, "falla": 3, "falha": 3, "erro": 3, "500": 2, "cae": 2, "bloqueado": 1, "dos": 1},
        "datos": {"reporte": 3, "relatorio": 3, "relatório": 3, "cuantos": 2, "cuántos": 2, "quantos": 2,
                  "ventas": 2, "vendas": 2, "metrica": 2, "métrica": 2},
        "acceso": {"acceso": 3, "acesso": 3, "permiso": 3, "permissão": 3, "cuenta": 1, "conta": 1, "alta": 1},
        "automatizacion": {"automatizar": 3, "automático": 2, "manual": 2, "planilla": 2, "planilha": 2,
                           "integrar": 2},
        "consulta": {"cómo": 2, "como": 1, "explicar": 2, "duda": 3, "dúvida": 3, "qué": 1},
        "otro": {},
    },
    "prioridad": {
        "alta": {"cobra": 2, "cobrando": 2, "clientes": 2, "urgente": 1, "bloqueado": 3, "legal": 3, "pagos": 2,
                 "pagamentos": 2},
        "media": {"interno": 2, "lento": 2, "lenta": 2, "error": 1, "erro": 1, "equipo": 1, "equipe": 1},
        "baja": {"duda": 2, "dúvida": 2, "mejora": 2, "melhoria": 2, "cuando": 1, "nuevo": 1, "novo": 1},
    },
    "area_sugerida": {
        "backend": {"api": 3, "cobra": 2, "cobrando": 2, "pagos": 2, "pagamentos": 2, "checkout": 1, "500": 1},
        "frontend": {"pantalla": 3, "tela": 3, "botón": 2, "botão": 2, "navegador": 2, "checkout": 2},
        "data": {"reporte": 3, "relatorio": 3, "relatório": 3, "ventas": 2, "vendas": 2, "metrica": 2,
                 "métrica": 2},
        "devops": {"acceso": 2, "acesso": 2, "servidor": 3, "permiso": 2, "permissão": 2, "lento": 1, "lenta": 1},
        "producto": {"política": 2, "duda": 2, "dúvida": 2, "cómo": 1, "como": 1, "explicar": 1},
        "digital_transformation": {"automatizar": 3, "planilla": 2, "planilha": 2, "integrar": 3, "manual": 1},
    },
    "idioma": {
        "es": {"el": 1, "la": 1, "los": 1, "las": 1, "del": 1, "que": 1, "y": 1, "con": 1, "para": 1, "por": 1,
               "en": 1, "una": 1, "cómo": 1, "está": 1, "hay": 1},
        "pt": {"o": 1, "os": 1, "da": 1, "do": 1, "das": 1, "que": 1, "e": 1, "com": 1, "para": 1, "por": 1,
               "em": 1, "uma": 1, "não": 1, "está": 1, "há": 1},
    },
}
# ---- Fixed values: labels without any hit, and the confidence that goes with none --------------
DEFAULT_LABELS = {"categoria": "otro", "prioridad": "media", "area_sugerida": "producto", "idioma": "es"}
NO_HIT_CONFIDENCE = 0.25
MIN_DETAIL_WORDS = 8
# ---- Fixed values: texts -----------------------------------------------------------------------
QUESTIONS = {"es": "¿Qué operación y qué clientes están afectados?", "pt": "Qual operação e quais clientes são afetados?"}
SUMMARY_PARTS = ("Solicitud interna de ", " para el equipo de ", " con prioridad ", ".")

Weights = dict[str, dict[str, dict[str, int]]]


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda token: token != "")


def vocabulary(lexicon: Weights = LEXICON) -> list[str]:
    return sorted({word for labels in lexicon.values() for words in labels.values() for word in words})


def _label_score(hits: Column, words: dict[str, int]) -> Column:
    total = F.lit(0)
    for weight in sorted(set(words.values())):
        tier = [word for word, value in words.items() if value == weight]
        total = total + F.size(F.filter(hits, lambda token: token.isin(*tier))) * weight
    return total.cast("long")


def with_hits(messages: DataFrame, text: str, lexicon: Weights = LEXICON) -> DataFrame:
    """Words of the text that occur in the vocabulary, repeated as often as they are said, and the word count."""
    known = vocabulary(lexicon)
    words = messages.withColumn("_tokens", tokens(F.col(text)))
    return words.select(
        *messages.columns,
        F.filter("_tokens", lambda token: token.isin(*known)).alias("_hits"),
        F.size("_tokens").alias("word_count"),
    )


def rubric_scores(messages: DataFrame, text: str = "message", key: str = "id", lexicon: Weights = LEXICON) -> DataFrame:
    """(key, dimension, label, score) for every label; no shuffle, each message is scored where it is read."""
    rows = [
        F.struct(
            F.lit(dimension).alias("dimension"), F.lit(label).alias("label"),
            _label_score(F.col("_hits"), words).alias("score"),
        )
        for dimension, labels in lexicon.items()
        for label, words in labels.items()
    ]
    return with_hits(messages, text, lexicon).select(key, F.inline(F.array(*rows)))


def rubric_labels(messages: DataFrame, text: str = "message", lexicon: Weights = LEXICON) -> DataFrame:
    """Messages with one label per dimension, confidence (share of the winning category) and the word count.

    Ties go to the label named first; a dimension without hits gets its default label.
    """
    scored = with_hits(messages, text, lexicon)
    for dimension, labels in lexicon.items():
        entries = [
            F.struct(_label_score(F.col("_hits"), words).alias("score"), F.lit(-place).alias("place"), F.lit(label).alias("label"))
            for place, (label, words) in enumerate(labels.items())
        ]
        scored = scored.withColumn(f"_{dimension}", F.array(*entries))
    best = {dimension: F.array_max(f"_{dimension}") for dimension in lexicon}
    labels = [
        F.when(best[d].getField("score") > 0, best[d].getField("label")).otherwise(DEFAULT_LABELS[d]).alias(d)
        for d in lexicon
    ]
    total = F.aggregate("_categoria", F.lit(0).cast("long"), lambda done, entry: done + entry.getField("score"))
    confidence = F.when(total > 0, best["categoria"].getField("score") / total).otherwise(NO_HIT_CONFIDENCE)
    return scored.select(*messages.columns, *labels, confidence.alias("confianza"), "word_count")


def rubric_answer(messages: DataFrame, text: str = "masked_message") -> DataFrame:
    """A complete answer per message: labels, a Spanish summary and a question where detail is missing."""
    labelled = rubric_labels(messages, text)
    needs = F.col("word_count") < MIN_DETAIL_WORDS
    question = F.when(F.col("idioma") == "pt", QUESTIONS["pt"]).otherwise(QUESTIONS["es"])
    start, area, priority, end = SUMMARY_PARTS
    summary = F.concat(
        F.lit(start), "categoria", F.lit(area), F.translate("area_sugerida", "_", " "), F.lit(priority), "prioridad",
        F.lit(end),
    )
    return labelled.select(
        *messages.columns, "categoria", "prioridad", "area_sugerida", "idioma",
        summary.alias("resumen"), needs.alias("requiere_info"), F.when(needs, question).alias("pregunta_seguimiento"),
        "confianza",
    )
