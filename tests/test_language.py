import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.operators import language as L
from sluice.operators.gram_arrays import GramWeights

DOCUMENTS = "/root/testdata/sf0.01/documents.parquet"
SAMPLE = [
    ("es", "El pago del cliente se cobra dos veces y la factura no aparece en el panel"),
    ("es", "Necesitamos acceso al tablero para revisar los registros duplicados del archivo"),
    ("pt", "O pagamento do cliente foi cobrado duas vezes e a nota não aparece no painel"),
    ("pt", "Precisamos de acesso ao quadro para revisar os registros duplicados do arquivo"),
    ("en", "The customer payment is charged twice and the invoice does not show in the panel"),
    ("en", "We need access to the board to review the duplicate records of the file"),
]


@pytest.fixture(scope="module")
def profile(spark):
    return L.build_lang_profile(spark.createDataFrame(SAMPLE, "lang string, text string"))


TEXTS = [
    (1, "La factura del cliente no aparece en el panel", "es"), (2, "A nota do cliente não aparece no painel", "pt"),
    (3, "the invoice of the customer does not show", "en"), (4, "12345 -- 678", None), (5, "", None), (6, None, None), (7, "жжж", None),
]


@pytest.mark.parametrize("broadcast_rows", [L.BROADCAST_ROWS, 0])
def test_verdicts_with_and_without_broadcast(spark, profile, broadcast_rows):
    texts = spark.createDataFrame([(n, text) for n, text, _ in TEXTS], "id int, text string")
    found = {row.id: row.lang_pred for row in L.predict_lang(texts, "text", profile, broadcast_rows=broadcast_rows).collect()}
    assert found == {n: lang for n, _, lang in TEXTS}
    accepted = L.spanish_accepted(texts, "text", profile, broadcast_rows=broadcast_rows).collect()
    assert {row.id for row in accepted if row.summary_accepted} == {1} and len(accepted) == len(TEXTS)


def test_both_forms_agree_on_documents(spark):
    documents = spark.read.parquet(DOCUMENTS)
    profile = L.build_lang_profile(documents)
    wide = L.predict_lang(documents, "text", profile, "doc_id")
    narrow = L.predict_lang(documents, "text", profile, "doc_id", broadcast_rows=0)
    assert wide.exceptAll(narrow).count() == 0 and wide.count() == documents.count()


def test_accuracy_on_held_out_documents(spark):
    documents = spark.read.parquet(DOCUMENTS)
    held_out = F.col("doc_id") % 5 == 0
    profile = L.build_lang_profile(documents.where(~held_out))
    tested = documents.where(held_out)
    verdicts = tested.join(L.predict_lang(tested, "text", profile, "doc_id"), "doc_id")
    right, total = verdicts.select(F.count(F.when(F.col("lang") == F.col("lang_pred"), 1)), F.count("*")).first()
    print(f"held-out language accuracy: {right}/{total}")
    assert right / total > 0.9


def test_trigrams_cover_the_whole_text(spark):
    rows = spark.createDataFrame([("Ab\n1c" + "x" * 50_000,)], "t string")
    grams = rows.select(L.trigrams(F.col("t")).alias("g")).first().g
    assert grams[:4] == [" ab", "ab ", "b c", " cx"] and len(grams) == 50_000 + 4


def test_arrays_equal_rows_of_trigrams(spark):
    """Counting and scoring on arrays against one row for each trigram, with other scripts, long texts and segments cut."""
    rows = spark.read.parquet(DOCUMENTS).select("doc_id", "lang", "text").unionByName(
        spark.createDataFrame([(-1, "ru", "Привет мир"), (-2, "zh", "漢字 仮名 漢字仮名"), (-3, None, "no language"), (-4, "en", None), (-5, "en", "1 2"), (-6, "xx", "\U00010428\U00010429\U0001042a \U00010428"), (-7, "en", "ab " * 900_000)], "doc_id long, lang string, text string")
    )
    plain = rows.where("lang IS NOT NULL").select("lang", F.explode(L.trigrams(F.col("text"))).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("n"))
    counted = L.gram_counts(rows, "text", "lang")
    assert counted.exceptAll(plain).count() == plain.exceptAll(counted).count() == 0
    profile = L.build_lang_profile(rows)
    fast, slow = (L.predict_lang(rows, "text", profile, "doc_id", broadcast_rows=n, hot_rows=500) for n in (L.BROADCAST_ROWS, 0))
    assert fast.exceptAll(slow).count() == 0 and fast.count() == slow.count() == rows.count()


def test_weights_with_and_without_cube():
    grams, langs, weights = ["abc", "abc", "bcd", "xyz", "ж\U00020000漢"], ["b", "a", "a", "b", "c"], np.array([5, 5, 1, 0, 7])
    texts = ["abc", "abcd", "xyz", "ж\U00020000漢", "qqq", None, "ab", "", "xyzbcd"]
    known = GramWeights(grams, langs, weights)
    assert known.cube is None and known.best(texts).to_pylist() == ["a", "a", "b", "c", None, None, None, None, "a"]
    small = GramWeights(grams[:4], langs[:4], weights[:4])
    assert small.cube is not None and small.best(texts).to_pylist() == ["a", "a", "b", None, None, None, None, None, "a"]


def test_policy_leaves_old_summaries_alone(spark):
    rows = spark.createDataFrame([(True, True), (True, False), (False, False), (False, None)], "summary_changed boolean, summary_accepted boolean")
    assert [row.policy_ok for row in L.policy_scope(rows).collect()] == [True, False, True, True]
