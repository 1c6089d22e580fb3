"""Message, reference, result and prompt files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice import fixed_values as V
from sluice import schemas


def read_records(spark: SparkSession, path: str, schema, array: bool = False) -> DataFrame:
    """JSON records, one per line (splittable) or, with ``array``, one top-level array per file.

    An array file is parsed by one task; several array files are read in parallel.
    """
    return spark.read.schema(schema).option("multiLine", array).option("mode", "FAILFAST").json(path)


def load_messages(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    return read_records(spark, path, schemas.MESSAGE, array)


def load_references(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    return read_records(spark, path, schemas.REFERENCE, array)


def load_results(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    return read_records(spark, path, schemas.CLASSIFICATION, array)


def prompt_files(spark: SparkSession, path: str) -> DataFrame:
    """Prompt files as (version, content), good and bad names alike. A prompt is one value, so one row per file.

    The version is the file's name (v1.md) or, for tables written by Spark, its folder's (version=v1/).
    """
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    file = F.col("_metadata.file_path")
    name = F.coalesce(
        F.nullif(F.regexp_extract(file, r"/version=([^/]*)/[^/]*$", 1), F.lit("")),
        F.regexp_extract(file, r"([^/]*)\.md$", 1),
    )
    return files.select(name.alias("version"), F.col("value").alias("content"))


def valid_prompts(prompts: DataFrame) -> DataFrame:
    """Versions named v1, v2, ... with content that is not blank."""
    return prompts.where(F.col("version").rlike(V.VERSION_NAME) & ~F.col("content").rlike(r"(?U)^\s*$"))


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of whole files, for inputs that are small files by nature (prompts, fixtures)."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(
        F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.sha2("content", 256).alias("sha256")
    )


def row_fingerprints(rows: DataFrame, key: str, text: str) -> DataFrame:
    return rows.select(F.col(key), F.sha2(F.col(text), 256).alias("sha256"))
