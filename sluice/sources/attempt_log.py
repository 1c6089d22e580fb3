"""The attempt log: JSON lines, read in splits and with every unusable line kept and named."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice import fixed_values as V
from sluice.functions.json_shape import BOOLEAN, INTEGER, NUMBER, OBJECT, STRING, field_type, json_type, parse_strict
from sluice.sources.workspace import settle

RUN_OF_FILE = r"run_id=([^/]+)/"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with file, position and run. Files are split; (block start, row number in scan order) orders a file."""
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path)
    return lines.select(
        F.col("value").alias("text"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("file_size"),
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("line"),
    ).withColumn("run_id", F.regexp_extract("file", RUN_OF_FILE, 1))


def _read(name: str, types: tuple[str, ...], kind: str) -> Column:
    """The field where it has one of the JSON types, else null; nothing is coerced."""
    value = F.col("_value")
    return F.when(field_type(value, name).isin(*types), F.try_variant_get(value, f"$.{name}", kind))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Typed event fields beside ``unparsable`` and ``is_event``; a value of another JSON type reads as null."""
    parsed = lines.withColumn("_value", parse_strict(F.col("text")))
    event = F.coalesce(_read("event", STRING, "string") == V.ATTEMPT_EVENT, F.lit(False))
    is_object = F.coalesce(json_type(F.col("_value")).isin(*OBJECT), F.lit(False))
    return parsed.select(
        *lines.columns,
        F.col("_value").isNull().alias("unparsable"),
        (is_object & event).alias("is_event"),
        *[_read(name, STRING, "string").alias(name) for name in ("message_id", "model", "prompt_version", "error_type")],
        *[
            _read(name, INTEGER, "long").alias(name)
            for name in ("attempt", "input_tokens", "output_tokens", "cached_input_tokens")
        ],
        *[_read(name, NUMBER, "double").alias(name) for name in ("latency_ms", "estimated_cost_usd")],
        _read("success", BOOLEAN, "boolean").alias("success"),
    )


def file_ends(lines: DataFrame) -> DataFrame:
    """Per file its last line, and whether a newline is missing at the end.

    A file of n complete lines has as many bytes as its lines plus n newlines, so one sum tells; no task has
    to hold a whole file.
    """
    return lines.groupBy("file").agg(
        F.max("line").alias("_last"), (F.sum(F.col("bytes") + 1) != F.max("file_size")).alias("_cut")
    )


def read_attempt_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good events, bad lines with reason ``truncated_final_event`` or ``invalid_event``).

    The text is parsed in one pass into a typed table; events, bad lines and file ends read that table.
    """
    lines = read_lines(spark, path).withColumn("bytes", F.octet_length("text").cast("long"))
    parsed = settle(parse_lines(lines).drop("text"))
    events = parsed.where("is_event").drop("bytes", "file_size", "unparsable", "is_event")
    bad = parsed.where(~F.col("is_event")).select("run_id", "file", "line", "unparsable")
    # Only files that end without a newline take part in the join.
    cut = file_ends(parsed).where("_cut").select("file", F.col("_last").alias("line"), F.lit(True).alias("_final"))
    reason = F.when(F.col("unparsable") & F.coalesce("_final", F.lit(False)), "truncated_final_event")
    bad = bad.join(cut, ["file", "line"], "left").select(
        "run_id", "file", "line", reason.otherwise("invalid_event").alias("reason")
    )
    return events, bad


def attempt_log_rows(attempts: DataFrame) -> DataFrame:
    """The columns a log may hold; message text is not among them."""
    rows = attempts.withColumn("event", F.lit(V.ATTEMPT_EVENT)).withColumn("latency_ms", F.round("latency_ms", 3))
    kept = [name for name in V.ATTEMPT_LOG_FIELDS if name in rows.columns]
    return rows.select("run_id", *kept)


def append_attempt_log(attempts: DataFrame, path: str) -> None:
    """Append JSON lines below run_id=<run>/. Null fields stay, but ``error_type`` is left out of successes."""
    rows = attempt_log_rows(attempts)
    always = [name for name in V.ATTEMPT_LOG_FIELDS if name in rows.columns and name != "error_type"]

    def line(names: list[str]) -> Column:
        return F.to_json(F.struct(*names), {"ignoreNullFields": "false"})

    text = F.when(F.col("error_type").isNull(), line(always)).otherwise(line([*always, "error_type"]))
    rows.select("run_id", text.alias("value")).write.mode("append").partitionBy("run_id").text(path)
