"""A training corpus from raw documents: quality, near duplicates, benchmark passages, personal data, packing.

Each stage works on all rows that its predecessor kept. ``run`` writes every stage's rows to the shared folder and reads
them back for the next one, so a lost executor costs at most one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.decontamination import decontaminated
from sluice.llm.ngram_join import ngram_classes
from sluice.llm.packing import pack_documents
from sluice.llm.pii import pseudonymised
from sluice.llm.quality import fit, scored
from sluice.sources.workspace import settle

#: Stands in for the caller's secret.
DEMONSTRATION_KEY = "demonstration"
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def numbered(docs: DataFrame) -> DataFrame:
    """The documents' columns with a number for each row, written down so that it stays: ids may be null or repeat."""
    return settle(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts (score of 0.5 or more).

    Null and empty texts are scored like others, null ids and repeated rows too; without labels all stay.
    """
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs.select(*COLUMNS), model, score_column="_score").where(F.col("_score") >= 0.5).drop("_score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) one row, with the smallest id (null the last).

    It works on rows: a different text under a repeated id is no copy, and rows with a null id take part. Texts without
    words are no copies of each other and all stay. Of repeated rows one stays. An empty table stays empty.
    """
    rows = numbered(docs)
    classes = ngram_classes(rows, id_column="_row", width=5, percent=80).select(F.col("doc_id").alias("_row"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))
    kept = rows.select("doc_id", "_row").join(classes, "_row").groupBy("component_id").agg(first.alias("first")).select("first._row")
    # The same plan at every size: what it shuffles grows with the input, not by a jump where a broadcast ends.
    return rows.join(settle(kept).hint("merge"), "_row", "left_semi").select(*COLUMNS)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark, whatever their id; null and empty texts stay, repeated rows go together."""
    return decontaminated(numbered(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_column="_row").select(*COLUMNS)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms in place of personal data; ``n_chars`` follows the text and is null with it. All rows stay."""
    changed = pseudonymised(docs.select(*COLUMNS), DEMONSTRATION_KEY)
    return changed.withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each row stands in the training sequences; a null or empty text is one end id."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_free),
    ("PII", private),
    ("best-fit packing", packed),
]

#: The classifier's fit and the tokenizer are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again. Further columns of the tables are not carried."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
