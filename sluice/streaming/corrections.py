"""Corrections as a stream folded over the stored requests, in buckets that are merged when they are read."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice import schemas
from sluice.operators.corrections import apply_latest, judge_corrections, latest_fields
from sluice.sources.buckets import BUCKETS, MOST_DELTAS, BucketTable
from sluice.sources.workspace import settle


def requests_table(spark: SparkSession, path: str) -> BucketTable:
    return BucketTable(spark, path, schemas.REQUEST)


def corrections_batch(table_path: str, rejected_path: str, most_deltas: int = MOST_DELTAS) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: the batch is judged against the requests that it names, read from their buckets.

    Batch n makes version 2n + 1, a delta of the corrected requests, and version 2n + 2, which differs only where buckets
    were compacted. A repeated batch starts from version 2n again and writes the same.
    """

    def run(batch: DataFrame, number: int) -> None:
        table = requests_table(batch.sparkSession, table_path)
        current = settle(table.read_keys(batch, 2 * number))
        judged = settle(judge_corrections(current, batch))
        judged.where(F.col("reason").isNotNull()).write.mode("overwrite").parquet(f"{rejected_path}/batch={number}")
        latest = settle(latest_fields(judged.where(F.col("reason").isNull())))
        changed = current.join(latest.select("id"), "id", "left_semi")
        after = table.put(apply_latest(changed, latest), 2 * number)
        if table.compact(after, most_deltas) == after:
            table.carry(after)

    return run


def stream_corrections(
    corrections: DataFrame, requests: DataFrame, table_path: str, rejected_path: str, checkpoint_path: str,
    buckets: int = BUCKETS, most_deltas: int = MOST_DELTAS,
):
    """Write the starting version once, then fold what is available now."""
    requests_table(corrections.sparkSession, table_path).create(requests, buckets)
    return resume_corrections(corrections, table_path, rejected_path, checkpoint_path, most_deltas)


def resume_corrections(corrections: DataFrame, table_path: str, rejected_path: str, checkpoint_path: str, most_deltas: int = MOST_DELTAS):
    return (
        corrections.writeStream.foreachBatch(corrections_batch(table_path, rejected_path, most_deltas))
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )
