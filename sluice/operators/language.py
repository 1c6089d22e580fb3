"""Language of short texts by character trigrams, and the summary language policy on top of it."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.text import word_count
from sluice import fixed_values as V
from sluice.operators.gram_arrays import GramWeights, count_grams
from sluice.operators.skew import HOT_ROWS, attach, attach_counted
from sluice.sources.workspace import settle

UNSEEN = 1e-6
SCALE = 1000
BROADCAST_ROWS = 2_000_000
WIDE_LANGUAGES = 64


def padded(text: Column) -> Column:
    """Lower-case letters, words apart by one space, a space at both ends; null where there are no letters."""
    letters = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "))
    return F.when(letters != "", F.concat(F.lit(" "), letters, F.lit(" ")))


def trigrams(text: Column) -> Column:
    """Character trigrams of the padded letters. A lookahead keeps this linear; it never begins inside a surrogate pair."""
    return F.regexp_extract_all(padded(text), F.lit(r"(?![\x{DC00}-\x{DFFF}])(?=(...))"), 1)


def gram_counts(labelled: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, gram, n), counted where the texts are read: only a batch's different trigrams become rows."""

    def count(batches):
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.slice(at, 2000)
                langs, grams, n = count_grams(part.column(0).to_pylist(), part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(grams, pa.string()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    rows = labelled.select(F.col(lang).cast("string").alias("lang"), padded(F.col(text)).alias("text")).where("lang IS NOT NULL")
    return rows.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def build_lang_profile(labelled: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(gram, lang, weight): log of the gram's share in the language over a fixed unseen share.

    With the same unseen share everywhere an absent gram weighs nothing, so the profile stays sparse.
    Weights are whole thousandths: their sums do not depend on the order of addition.
    """
    counts = settle(gram_counts(labelled, text, lang))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("_rows"))
    joined = attach(counts, totals, ["lang"], ["gram"])
    share = F.col("n") / F.col("total")
    weight = F.round(F.log(F.lit(1.0) + share / F.lit(UNSEEN)) * SCALE).cast("long")
    return joined.select("gram", "lang", weight.alias("weight"))


def predict_lang(
    texts: DataFrame, text: str, profile: DataFrame, key: str = "id", broadcast_rows: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """(key, lang_pred): best total weight, ties to the first language name, null without a known trigram.

    A profile within ``broadcast_rows`` and ``WIDE_LANGUAGES`` (both checked by counting) goes to every task as a table of
    weights, and each text is scored where it is read, without a shuffle. A larger one is joined by trigram, one row
    for each with its languages; frequent trigrams are salted by how often they occur. ``key`` names one text.
    """
    profile = settle(profile)
    rows = profile.limit(broadcast_rows + 1).count()
    langs = profile.select("lang").distinct().limit(WIDE_LANGUAGES + 1).count()
    if rows <= broadcast_rows and 0 < langs <= WIDE_LANGUAGES:
        known = profile.toArrow()  # at most ``broadcast_rows`` rows
        weights = GramWeights(known.column("gram").to_pylist(), known.column("lang").to_pylist(), known.column("weight").to_numpy())
        shared = texts.sparkSession.sparkContext.broadcast(weights)
        wanted = texts.select(F.col(key), padded(F.col(text)).alias("_text"))

        def score(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), shared.value.best(batch.column(1).to_pylist())], [key, "lang_pred"])

        kind = f"`{key}` {wanted.schema[key].dataType.simpleString()}, lang_pred string"
        return wanted.mapInArrow(score, kind)
    grams = texts.select(key, F.explode_outer(trigrams(F.col(text))).alias("gram"))
    counted = settle(grams.groupBy(key, "gram").agg(F.count("*").alias("_n")))
    weighed = profile.groupBy("gram").agg(F.collect_list(F.struct("lang", "weight")).alias("_weights"))  # as many as there are languages
    hits = attach_counted(counted, weighed, ["gram"], [key], hot_rows=hot_rows)
    hits = hits.select(key, "_n", F.explode_outer("_weights").alias("_w"))
    scores = hits.groupBy(key, F.col("_w.lang").alias("lang")).agg(F.sum(F.col("_w.weight") * F.col("_n")).alias("_score"))
    best = F.min(F.when(F.col("lang").isNotNull(), F.struct((-F.col("_score")).alias("s"), "lang")))
    return scores.groupBy(key).agg(best.alias("_best")).select(key, F.col("_best.lang").alias("lang_pred"))


def spanish_accepted(
    summaries: DataFrame, text: str, profile: DataFrame, key: str = "id", broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """(key, summary_accepted): Spanish is the top verdict; text without a verdict is turned away."""
    verdict = predict_lang(summaries, text, profile, key, broadcast_rows)
    return verdict.select(key, F.coalesce(F.col("lang_pred") == "es", F.lit(False)).alias("summary_accepted"))


def policy_scope(rows: DataFrame, changed: str = "summary_changed", accepted: str = "summary_accepted") -> DataFrame:
    """The policy binds new results and edited summaries only; other rows pass unchecked."""
    return rows.withColumn("policy_ok", F.when(F.col(changed), F.col(accepted)).otherwise(F.lit(True)))


def summary_compliance(results: DataFrame) -> DataFrame:
    """Per run how many summaries are Spanish and how many keep to the word limit."""
    fits = word_count(F.col("resumen")).between(1, V.SUMMARY_MAX_WORDS)
    return results.groupBy("run_id").agg(
        F.count("*").alias("summaries"),
        F.count(F.when(F.col("summary_accepted"), 1)).alias("spanish"),
        F.count(F.when(fits, 1)).alias("within_limit"),
    )
