"""The requests table: versions of a parquet folder, a new one per change."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice import schemas
from sluice.operators.requests import content_of
from sluice.sources.buckets import BucketTable
from sluice.sources.workspace import settle


def requests_scan(spark: SparkSession, path: str) -> DataFrame:
    """Stored requests with native nested columns: labels and times are pruned and pushed down by Spark."""
    return spark.read.schema(schemas.REQUEST).parquet(path)


def decode_text_rows(rows: DataFrame) -> DataFrame:
    """Imported rows whose nested records are JSON text, to the stored form."""
    strict = {"mode": "FAILFAST"}
    return rows.select(
        "id", "raw_message", "state",
        F.from_json("ai_classification_json", schemas.CLASSIFICATION, strict).alias("ai_classification"),
        F.from_json("human_correction_json", schemas.CONTENT, strict).alias("human_correction"),
        F.from_json("provider_metadata_json", schemas.METADATA, strict).alias("provider_metadata"),
        "effective_category", "effective_priority", "effective_area", "failure_code",
        "created_at", "updated_at", "classified_at", "corrected_at",
    )


def encode_json(record: Column) -> Column:
    """A record as JSON text with its nulls spelled out, as the contract asks."""
    return F.to_json(record, {"ignoreNullFields": "false"})


def write_version(requests: DataFrame, path: str) -> None:
    """A new version; rows of a file are in time order, so row groups can be skipped by ``created_at``."""
    requests.sortWithinPartitions("created_at").write.mode("errorifexists").parquet(path)


#: Characters of a failure code.
SANITIZED = r"^[a-z_]+$"


def guard_finished(finished: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what may be stored, what may not with its ``reason``).

    A classification has to carry the ID that it is stored under (``other_id``), a failure needs a code of lower-case
    letters and underscores (``failure_code``), and of an ID that is finished more than once nothing is stored (``repeated``).
    """
    good = F.col("classification").isNotNull()
    reason = (
        F.when(good & ~F.col("classification.id").eqNullSafe(F.col("id")), "other_id")
        .when(~good & ~F.coalesce(F.col("error_type").rlike(SANITIZED), F.lit(False)), "failure_code")
    )
    finished = settle(finished)  # read for the counts and for the rows
    often = finished.groupBy("id").agg(F.count("*").alias("_rows")).where("_rows > 1").select("id", F.lit(True).alias("_often"))
    judged = finished.join(often, "id", "left").withColumn("reason", F.coalesce(reason, F.when(F.col("_often"), "repeated"))).drop("_often")
    return judged.where(F.col("reason").isNull()).drop("reason"), judged.where(F.col("reason").isNotNull())


def upsert_bucketed(table: BucketTable, version: int, reserved: DataFrame, finished: DataFrame) -> int:
    """The version after ``version``: only the buckets of the given IDs are read, and written as deltas.

    Arguments as of ``upsert_requests``. Rows that stay as they are go into no delta. What is given is computed once, however
    often it is read here.
    """
    reserved, finished = settle(reserved), settle(finished)
    keys = reserved.select("id").unionByName(finished.select("id"))
    before = table.read_keys(keys, version)
    after = _upserted(before, reserved, finished)
    return table.put(after.where(~F.col("_state").eqNullSafe(F.col("state"))).drop("_state"), version)


def upsert_requests(stored: DataFrame, reserved: DataFrame, finished: DataFrame) -> DataFrame:
    """The next version: new reservations added, processing requests completed or failed.

    ``reserved`` (id, raw_message, arrival) of first submissions; ``finished`` has at most one row per ID
    (id, at, classification, metadata, error_type). Stored IDs are never taken again, and only processing
    rows change.
    """
    return _upserted(stored, reserved, finished).drop("_state")


def _upserted(stored: DataFrame, reserved: DataFrame, finished: DataFrame) -> DataFrame:
    """The next version with ``_state``, the state before; null of new rows."""
    new = reserved.join(stored.select("id"), "id", "left_anti").select(
        "id", "raw_message", F.lit("processing").alias("state"),
        F.col("arrival").alias("created_at"), F.col("arrival").alias("updated_at"),
    )
    everything = stored.withColumn("_state", F.col("state")).unionByName(new, allowMissingColumns=True)
    joined = everything.join(finished, "id", "left")
    done = F.col("at").isNotNull() & (F.col("state") == "processing")
    good = done & F.col("classification").isNotNull()
    bad = done & F.col("classification").isNull()

    def pick(name: str, value: Column, when: Column) -> Column:
        return F.when(when, value).otherwise(F.col(name)).alias(name)

    content = content_of(F.col("classification"))
    return joined.select(
        "id", "raw_message",
        F.when(good, "completed").when(bad, "failed").otherwise(F.col("state")).alias("state"),
        pick("ai_classification", F.col("classification"), good),
        "human_correction",
        pick("provider_metadata", F.col("metadata"), good),
        pick("effective_category", content.getField("categoria"), good),
        pick("effective_priority", content.getField("prioridad"), good),
        pick("effective_area", content.getField("area_sugerida"), good),
        pick("failure_code", F.col("error_type"), bad),
        "created_at",
        pick("updated_at", F.col("at"), done),
        pick("classified_at", F.col("at"), good),
        "corrected_at", "_state",
    )
