"""Running usage per run while attempt logs grow."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.money import COST, known_sum
from sluice.sources.attempt_log import RUN_OF_FILE, parse_lines


def tail_lines(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Lines of log files as they appear below run_id=<run>/."""
    lines = (
        spark.readStream.option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True).text(path)
    )
    file = F.col("_metadata.file_path")
    return lines.select(F.col("value").alias("text"), F.regexp_extract(file, RUN_OF_FILE, 1).alias("run_id"))


def running_usage(lines: DataFrame) -> DataFrame:
    """Per run: events, unusable lines and known subtotals over all observed events.

    One row of state per run; the aggregate is partial before the shuffle, so one busy run is no hot spot.
    """
    event = F.col("is_event")
    return (
        parse_lines(lines)
        .groupBy("run_id")
        .agg(
            F.count(F.when(event, 1)).alias("observed_model_calls"),
            F.count(F.when(~event, 1)).alias("invalid_lines"),
            known_sum(F.when(event, F.col("input_tokens"))).alias("input_tokens_known_subtotal"),
            known_sum(F.when(event, F.col("output_tokens"))).alias("output_tokens_known_subtotal"),
            known_sum(F.when(event, F.col("estimated_cost_usd")).cast("string").try_cast(COST)).alias(
                "estimated_cost_usd_known_subtotal"
            ),
        )
    )


def stream_usage(lines: DataFrame, output_path: str, checkpoint_path: str):
    """Write, for each batch, the new totals of the runs that it touches, into the folder of its own number.

    Other runs are neither read nor written again: their totals stand in an earlier batch's folder.
    """

    def write_totals(totals: DataFrame, number: int) -> None:
        totals.write.mode("overwrite").parquet(f"{output_path}/batch={number}")

    return (
        running_usage(lines).writeStream.outputMode("update").foreachBatch(write_totals)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )


def latest_usage(spark: SparkSession, output_path: str) -> DataFrame:
    """Totals of every run as of its last batch."""
    written = spark.read.parquet(output_path)
    names = [name for name in written.columns if name not in ("run_id", "batch")]
    return written.groupBy("run_id").agg(F.max_by(F.struct(*names), "batch").alias("_t")).select("run_id", "_t.*")
