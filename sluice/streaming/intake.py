"""Idempotent intake and lifecycle of a stream, with a small state for each request.

Queries with a checkpoint each. ``stage_intake`` writes every micro-batch under its number, and beside it one row for
each ID: its first submission and its first terminal event, by partial aggregates, so that a hot ID is one row however
often it occurs. ``decide_intake`` reads those rows in two streaming aggregations keyed by ID, whose state stays in RocksDB
and in the JVM: the digest of the text that reserved the ID, with its batch, then the first terminal event from that batch on.
They touch the keys of a micro-batch and no others, so their cost does not grow with all that was ever reserved. Decisions
are joined back to the staged rows with the batch form's salts.

Every output is a folder of a batch's number and is written again, with the same rows, when a batch is repeated.
"""

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sluice.functions.text import is_blank
from sluice.operators.skew import HOT_ROWS, attach

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FIRSTS = "id string, digest binary, place long, target string, failure_code string, end_place long, _rows long, batch long"
DECISIONS = (
    "batch long, id string, owner binary, created_place long, before string, ended_place long, state string, failure_code string, _rows long"
)
OWNERS = "id string, born long, owner binary, newest long"
OWNED = f"{FIRSTS}, born long, owner binary"
ENDS = "id string, ended long, reached string, newest long"


def _valid():
    unfit = [F.col(name).isNull() | is_blank(F.col(name)) for name in ("id", "raw_message")]
    return ~(unfit[0] | unfit[1])


def batch_firsts(staged: DataFrame, order: list[str]) -> DataFrame:
    """One row per ID: its first valid submission, its first terminal event, and how many rows it has."""
    submitted = F.col("target").isNull() & _valid()
    text = F.unhex(F.sha2(F.col("raw_message").cast("binary"), 256))
    first = F.min(F.when(submitted, F.struct(*order, "raw_message", "_place", text.alias("digest"))))
    end = F.min(F.when(F.col("target").isNotNull(), F.struct(*order, "target", "failure_code", "_place")))
    rows = staged.where(F.col("id").isNotNull()).groupBy("id").agg(first.alias("f"), end.alias("e"), F.count("*").alias("_rows"))
    return rows.select(
        "id", "f.digest", F.col("f._place").alias("place"), "e.target", "e.failure_code", F.col("e._place").alias("end_place"), "_rows"
    )


def stage_intake(rows: DataFrame, base: str, order: list[str]) -> StreamingQuery:
    """Submissions (id, raw_message, ``order``) and terminal events (id, target, failure_code, ``order``) of one stream.

    A row with a target is an event. ``order`` puts the rows of an ID in order inside a batch.
    """
    for name in ("target", "failure_code"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))

    def run(batch: DataFrame, number: int) -> None:
        path = f"{base}/staged/batch={number}"
        batch.withColumn("_place", F.monotonically_increasing_id()).write.mode("overwrite").parquet(path)
        staged = batch.sparkSession.read.parquet(path)
        batch_firsts(staged, order).write.mode("overwrite").parquet(f"{base}/firsts/batch={number}")

    return rows.writeStream.foreachBatch(run).option("checkpointLocation", f"{base}/checkpoint-stage").trigger(availableNow=True).start()


def outcomes(staged: DataFrame, decisions: DataFrame, order: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every staged row with its outcome; the rows of hot IDs are salted.

    Submissions: ``invalid``, ``conflict``, ``duplicate_completed``, ``in_progress`` and ``failed_terminal`` (by the state
    before the batch), ``created`` (one row of an ID, ever), ``duplicate`` (of a submission of the same batch). Events:
    ``applied`` (one of an ID, ever), ``not_processing``, ``not_found``.
    """
    joined = attach(staged, decisions.drop("failure_code"), ["batch", "id"], [*order, "_place"], hot_rows=hot_rows)
    digest = F.unhex(F.sha2(F.col("raw_message").cast("binary"), 256))
    event = (
        F.when(F.col("owner").isNull(), "not_found").when(F.col("_place") == F.col("ended_place"), "applied").otherwise("not_processing")
    )
    submission = (
        F.when(~_valid(), "invalid")
        .when(digest != F.col("owner"), "conflict")
        .when(F.col("before") == "completed", "duplicate_completed")
        .when(F.col("before") == "processing", "in_progress")
        .when(F.col("before") == "failed", "failed_terminal")
        .when(F.col("_place") == F.col("created_place"), "created")
        .otherwise("duplicate")
    )
    judged = joined.withColumn("outcome", F.when(F.col("target").isNotNull(), event).otherwise(submission))
    return judged.select(*[name for name in staged.columns if name != "_place"], "outcome")


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB and upload its changes, not all of it, after each batch."""
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    }
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _unseen(found: DataFrame, path: str, number: int) -> tuple[int, int]:
    """First and last number of the folders that no step before ``number`` has seen; ``found`` has the ``newest`` number by ID."""
    session = found.sparkSession
    before = session.read.schema("newest long").parquet(f"{path}/step={number - 1}").first()[0] if number else -1
    newest = found.agg(F.max("newest")).first()[0]
    newest = before if newest is None else max(before, newest)
    session.range(1).select(F.lit(newest).cast("long").alias("newest")).write.mode("overwrite").parquet(f"{path}/step={number}")
    return before + 1, newest


def decisions(owned: DataFrame, ends: DataFrame) -> DataFrame:
    """What a staged batch changes for its IDs. ``owned``: its firsts with the ``owner`` digest and the batch that it was ``born`` in."""
    rows = owned.join(ends.select("id", "ended", "reached"), "id")
    mine = F.coalesce(F.col("born") <= F.col("batch"), F.lit(False))
    over = F.coalesce(F.col("ended") < F.col("batch"), F.lit(False))  # before this batch
    applied = mine & ~over & F.col("target").isNotNull()  # after the batch's submissions
    return rows.select(
        "batch", "id", F.when(mine, F.col("owner")).alias("owner"),
        F.when(F.col("born") == F.col("batch"), F.col("place")).alias("created_place"),
        F.when(F.col("born") < F.col("batch"), F.when(over, F.col("reached")).otherwise("processing")).alias("before"),
        F.when(applied, F.col("end_place")).alias("ended_place"),
        F.when(mine, F.when(over, F.col("reached")).otherwise(F.coalesce("target", F.lit("processing")))).alias("state"),
        F.when(applied, F.col("failure_code")).alias("failure_code"), "_rows",
    )


def _updates(changes: DataFrame, run, checkpoint: str) -> StreamingQuery:
    writer = changes.writeStream.foreachBatch(run).outputMode("update").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def own_intake(spark: SparkSession, base: str) -> StreamingQuery:
    """The first valid submission reserves an ID for good: ``owned`` has the staged firsts with their IDs' owners."""
    firsts = spark.readStream.schema(FIRSTS).parquet(f"{base}/firsts")
    first = F.min(F.when(F.col("digest").isNotNull(), F.struct("batch", "digest")))
    changes = firsts.groupBy("id").agg(first.alias("b"), F.max("batch").alias("newest"))

    def run(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        path = f"{base}/owners/step={number}"
        batch.select("id", F.col("b.batch").alias("born"), F.col("b.digest").alias("owner"), "newest").write.mode("overwrite").parquet(path)
        owners = session.read.schema(OWNERS).parquet(path)
        # A staged batch that was written again has been seen.
        fresh = F.col("batch").between(*_unseen(owners, f"{base}/seen-firsts", number))
        rows = session.read.schema(FIRSTS).parquet(f"{base}/firsts").where(fresh)
        rows.join(owners.drop("newest"), "id").write.mode("overwrite").parquet(f"{base}/owned/step={number}")

    return _updates(changes, run, f"{base}/checkpoint-own")


def end_intake(spark: SparkSession, base: str, order: list[str], hot_rows: int = HOT_ROWS) -> StreamingQuery:
    """The first terminal event of an owned ID ends it; events of batches before it was owned do not count."""
    owned = spark.readStream.schema(f"{OWNED}, step long").parquet(f"{base}/owned")
    counts = (F.col("born") <= F.col("batch")) & (F.col("target") != "processing")
    first = F.min(F.when(counts, F.struct("batch", "target")))
    changes = owned.groupBy("id").agg(first.alias("e"), F.max("step").alias("newest"))

    def run(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        path = f"{base}/ends/step={number}"
        batch.select("id", F.col("e.batch").alias("ended"), F.col("e.target").alias("reached"), "newest").write.mode("overwrite").parquet(path)
        ends = session.read.schema(ENDS).parquet(path)
        fresh = F.col("step").between(*_unseen(ends, f"{base}/seen-owned", number))
        rows = session.read.schema(f"{OWNED}, step long").parquet(f"{base}/owned").where(fresh)
        path = f"{base}/decided/step={number}"
        decisions(rows, ends).write.mode("overwrite").parquet(path)
        decided = session.read.schema(DECISIONS).parquet(path)
        for (staged_batch,) in decided.select("batch").distinct().collect():  # numbers of the micro-batches just staged
            staged = session.read.parquet(f"{base}/staged/batch={staged_batch}").withColumn("batch", F.lit(staged_batch).cast("long"))
            now = decided.where(F.col("batch") == staged_batch)
            # Rows without an ID are in no decision and come out as invalid.
            found = outcomes(staged, now, order, hot_rows).drop("batch")
            found.write.mode("overwrite").parquet(f"{base}/outcomes/batch={staged_batch}")

    return _updates(changes, run, f"{base}/checkpoint-end")


def decide_intake(spark: SparkSession, base: str, order: list[str], hot_rows: int = HOT_ROWS) -> StreamingQuery:
    """Decide what is staged: ``decided`` has a row for each ID and batch, ``outcomes`` one for each staged row."""
    with rocksdb_state(spark):
        own_intake(spark, base).awaitTermination()
        return end_intake(spark, base, order, hot_rows)


def stream_intake(rows: DataFrame, base: str, order: list[str], hot_rows: int = HOT_ROWS) -> StreamingQuery:
    """Stage and decide what is available now; run it again with the same ``base`` to go on."""
    stage_intake(rows, base, order).awaitTermination()
    return decide_intake(rows.sparkSession, base, order, hot_rows)


def request_states(spark: SparkSession, base: str) -> DataFrame:
    """Current state of every reserved ID, from the decisions."""
    decided = spark.read.schema(f"{DECISIONS}, step long").option("basePath", f"{base}/decided").parquet(f"{base}/decided")
    last = F.max_by(F.struct("owner", "state"), "batch")
    return decided.where(F.col("owner").isNotNull()).groupBy("id").agg(last.alias("l"), F.max("failure_code").alias("failure_code")).select(
        "id", F.col("l.owner").alias("digest"), "l.state", "failure_code"
    )
