"""Join rows of any skew to one row per key."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
SMALL_SPLITS = 64


def spread(rows: DataFrame) -> DataFrame:
    """Deal a small scan out over all cores before heavy per-row work.

    A file of one row group is read by one task however many cores there are. Scans of more than a few splits
    per core, and all scans from ``SMALL_SPLITS`` splits on, are left as they are: no shuffle is added at scale.
    Only for plans without a shuffle, whose splits are known before anything runs.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < min(2 * cores, SMALL_SPLITS) else rows


def attach(
    rows: DataFrame,
    per_key: DataFrame,
    keys: list[str],
    spread_by: list[str],
    rows_column: str = "_rows",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Left join ``rows`` with ``per_key``, which has one row per key and counts the key's rows.

    A key with more than ``hot_rows`` rows is spread over ``ceil(rows / hot_rows)`` salts by a hash of the
    ``spread_by`` columns, and only that key's row is repeated. The broadcast list of hot keys cannot be longer
    than (all rows / hot_rows), whatever the data. A join with an aggregate of the same rows is not split by
    adaptive execution, hence the salt.
    """
    sized = per_key.withColumn("_salts", F.greatest(F.ceil(F.col(rows_column) / F.lit(hot_rows)), F.lit(1)))
    hot = sized.where(F.col("_salts") > 1).select(*keys, "_salts")
    salted_rows = (
        rows.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*spread_by), F.col("_salts")), F.lit(0)).cast("long"))
        .drop("_salts")
    )
    salted_keys = sized.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts").cast("long") - 1))
    ).drop("_salts", rows_column)
    return salted_rows.join(salted_keys, [*keys, "_salt"], "left").drop("_salt")


def attach_counted(
    rows: DataFrame, per_key: DataFrame, keys: list[str], spread_by: list[str], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``attach`` for a ``per_key`` table that comes from elsewhere: the rows of every key are counted first."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_rows"))
    return attach(rows, counts.join(per_key, keys, "left"), keys, spread_by, hot_rows=hot_rows)
