"""Fingerprints of whole tables, as sums that merge over partitions.

Each row is hashed with SHA-256; four 60-bit pieces of the hash are added up, exactly, beside the number of rows. Sums do not
depend on how a table is split, so partial digests of parts, days or files can be kept and merged. Equal rows count as often
as they occur. Where the order matters a row is hashed together with its position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.sources.workspace import settle

PIECES = tuple(f"h{k}" for k in range(4))
SUM = "decimal(38,0)"


def canonical(*columns: str) -> Column:
    """A row as text: JSON with nulls spelled out and the columns in order of their names."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def partial_digest(rows: DataFrame, by: tuple[str, ...] = (), row: Column | None = None, position: str | None = None) -> DataFrame:
    """(``by``, rows, h0 .. h3). ``row`` is a row's text, by default all columns but ``by`` and ``position``."""
    text = canonical(*[name for name in rows.columns if name not in (*by, position)]) if row is None else row
    if position is not None:
        text = F.concat_ws(":", F.col(position).cast("string"), text)
    told = rows.select(*by, F.sha2(text, 256).alias("_told"))
    pieces = [F.sum(F.conv(F.substring("_told", 16 * k + 1, 15), 16, 10).cast(SUM)).cast(SUM).alias(name) for k, name in enumerate(PIECES)]
    return told.groupBy(*by).agg(F.count("*").alias("rows"), *pieces)


def merge_digests(partials: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return partials.groupBy(*by).agg(F.sum("rows").alias("rows"), *[F.sum(name).cast(SUM).alias(name) for name in PIECES])


def finish_digest(partials: DataFrame) -> DataFrame:
    """One text for the sums; no rows at all have a digest too."""
    sums = [F.coalesce(F.col(name).cast("string"), F.lit("0")) for name in PIECES]
    others = [name for name in partials.columns if name not in ("rows", *PIECES)]
    return partials.select(*others, F.coalesce("rows", F.lit(0)).alias("rows"), F.sha2(F.concat_ws("-", F.coalesce("rows", F.lit(0)).cast("string"), *sums), 256).alias("sha256"))


def table_digest(rows: DataFrame, by: tuple[str, ...] = (), row: Column | None = None, position: str | None = None) -> DataFrame:
    """(``by``, rows, sha256): changes when a row changes, comes, goes or is repeated, and with ``position`` when rows move."""
    return finish_digest(partial_digest(rows, by, row, position))


def with_positions(rows: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """``rows`` numbered from 0 in the total order of these columns.

    Ranges of the order are sorted side by side; only their sizes (one row for each) are added up and sent to all tasks.
    """
    place = F.monotonically_increasing_id()
    ranged = settle(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", place)
        .withColumn("_range", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))
    )
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_size"))
    starts = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    joined = ranged.join(F.broadcast(starts), "_range")  # as many rows as there are shuffle partitions
    return joined.select(*rows.columns, (F.col("_start") + F.col("_at")).alias(name))


def table_drift(recorded: DataFrame, current: DataFrame, key: str = "name") -> DataFrame:
    """(key, drift) of recorded digests (key, sha256) against current ones: ``same``, ``changed``, ``gone`` or ``new``."""
    now = current.select(key, F.col("sha256").alias("_now"))
    joined = recorded.select(key, "sha256").join(now, key, "full")
    drift = F.when(F.col("_now").isNull(), "gone").when(F.col("sha256").isNull(), "new").when(F.col("sha256") == F.col("_now"), "same").otherwise("changed")
    return joined.select(key, drift.alias("drift"))
