"""The bucketed table against a dictionary, and how much of it each change writes and reads."""

import random

import pytest
from pyspark.sql import functions as F

from sluice.sources.buckets import BucketTable
from sluice.sources.store import guard_finished, upsert_bucketed
from sluice import schemas
from tests.test_corrections import BASE, START, _request

SCHEMA = "id string, value long, note string"


@pytest.fixture
def table(spark, tmp_path):
    return BucketTable(spark, str(tmp_path / "table"), spark.createDataFrame([], SCHEMA).schema)


def _rows(table, version=None):
    return {r.id: (r.value, r.note) for r in table.read(version).collect()}


def test_versions_equal_a_dictionary(spark, table):
    rng = random.Random(4)
    kept = {f"k{n}": (n, None) for n in range(300)}
    version = table.create(spark.createDataFrame([(k, *v) for k, v in kept.items()], SCHEMA), 8)
    history = {version: dict(kept)}
    for step in range(6):
        changed = {f"k{rng.randrange(400)}": (step * 1000 + n, "x" if n % 2 else None) for n in range(rng.choice([0, 1, 3, 40]))}
        version = table.put(spark.createDataFrame([(k, *v) for k, v in changed.items()], SCHEMA), version)
        kept |= changed
        history[version] = dict(kept)
        compacted = table.compact(version, 2)
        if compacted != version:
            version = compacted
            history[version] = dict(kept)
    assert len(history) > 7 and table.latest() == version
    for number, rows in history.items():
        assert _rows(table, number) == rows, number
        assert table.read(number).count() == len(rows)


def test_change_touches_its_buckets_only(spark, table):
    rows = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("id"), F.col("id").alias("value"), F.lit("n").alias("note"))
    table.create(rows, 32)
    one = spark.createDataFrame([("k7", -1, "new"), ("fresh", -2, "new")], SCHEMA)
    assert table.put(one, 0) == 1 and table.rewritten(0) == 32 and table.rewritten(1) <= 2
    keys = one.select("id")
    files = table.read_keys(keys, 1)
    assert {r.id: r.value for r in files.collect()} == {"k7": -1, "fresh": -2}
    assert len({f.split("/bucket=")[1].split("/")[0] for f in files.inputFiles()}) <= 2  # of 32 buckets
    assert table.compact(1) == 1
    for step in range(1, 4):
        table.put(one.withColumn("value", F.lit(step).cast("long")), step)
    assert table.compact(4, 2) == 5 and table.rewritten(5) <= 2 and _rows(table, 5)["k7"] == (3, "new")
    assert table.put(one, 0) == 1 and _rows(table, 1)["k7"] == (-1, "new")  # a change that is written again


def test_odd_tables(spark, table):
    empty = spark.createDataFrame([], SCHEMA)
    assert table.create(empty, 4) == 0 and _rows(table) == {}
    assert table.put(empty, 0) == 1 and _rows(table) == {}
    assert table.put(spark.createDataFrame([("a", 1, None)], SCHEMA), 1) == 2 and _rows(table) == {"a": (1, None)}
    assert table.read_keys(spark.createDataFrame([(None,), ("b",)], "id string"), 2).count() == 0


def test_guards_of_upserts(spark):
    request = spark.createDataFrame([_request("a", "completed", BASE)], schemas.REQUEST)
    done = request.select(
        F.explode(F.array(*[
            F.struct(F.lit(i).alias("id"), F.lit(own).alias("own"), F.lit(code).alias("error_type"))
            for i, own, code in [("a", "a", None), ("b", "z", None), ("c", None, "timeout"), ("d", None, "HTTP 500"), ("e", None, None), ("f", None, ""), ("g", None, "timeout"), ("g", None, "timeout")]
        ])).alias("r"), "ai_classification", F.col("created_at").alias("at"), F.col("provider_metadata").alias("metadata"),
    ).select("r.id", "at", F.when(F.col("r.own").isNotNull(), F.col("ai_classification").withField("id", F.col("r.own"))).alias("classification"), "metadata", "r.error_type")
    good, bad = guard_finished(done)
    assert sorted(r.id for r in good.collect()) == ["a", "c"]
    assert sorted((r.id, r.reason) for r in bad.collect()) == [("b", "other_id"), ("d", "failure_code"), ("e", "failure_code"), ("f", "failure_code"), ("g", "repeated"), ("g", "repeated")]


def test_upsert_reads_and_writes_its_ids_only(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "requests"), schemas.REQUEST)
    table.create(spark.createDataFrame([_request(f"r{n}", "processing" if n % 2 else "completed", BASE) for n in range(200)], schemas.REQUEST), 16)
    reserved = spark.createDataFrame([("new", "text", START), ("r4", "other", START)], "id string, raw_message string, arrival timestamp")
    kind = f"id string, at timestamp, classification {schemas.CLASSIFICATION.simpleString()}, metadata {schemas.METADATA.simpleString()}, error_type string"
    finished = spark.createDataFrame([("r1", START, None, None, "timeout"), ("r2", START, None, None, "timeout")], kind)
    assert upsert_bucketed(table, 0, reserved, finished) == 1
    states = {r.id: (r.state, r.failure_code) for r in table.read(1).collect()}
    assert len(states) == 201 and states["new"] == ("processing", None) and states["r1"] == ("failed", "timeout")
    assert states["r2"] == ("completed", None) and states["r4"][0] == "completed" and table.rewritten(1) <= 2


def test_upsert_computes_what_it_is_given_once(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "once"), schemas.REQUEST)
    table.create(spark.createDataFrame([_request("a", "processing", BASE), _request("b", "completed", BASE)], schemas.REQUEST), 4)
    counts = [spark.sparkContext.accumulator(0) for _ in range(2)]

    def counted(rows, counter, kind):
        def each(batches):
            for batch in batches:
                counter.add(batch.num_rows)
                yield batch

        return spark.createDataFrame(rows, kind).mapInArrow(each, kind)

    reserved = counted([("b", "x", START), ("c", "y", START)], counts[0], "id string, raw_message string, arrival timestamp")
    ended = counted([("a", START, "timeout"), ("b", START, "timeout"), ("c", START, "Bad Code")], counts[1], "id string, at timestamp, error_type string")
    for name, kind in (("classification", schemas.CLASSIFICATION), ("metadata", schemas.METADATA)):
        ended = ended.withColumn(name, F.lit(None).cast(kind))
    version = upsert_bucketed(table, 0, reserved, guard_finished(ended)[0])
    assert {r.id: (r.state, r.failure_code) for r in table.read(version).collect()} == {"a": ("failed", "timeout"), "b": ("completed", None), "c": ("processing", None)}
    assert [c.value for c in counts] == [2, 3]


def test_few_keys_go_to_the_rows_of_their_buckets(spark, table):
    version = table.create(spark.range(2000).selectExpr("concat('k', id) AS id", "id AS value", "'n' AS note"), 8)
    # Spark can only guess that this gives four keys.
    keys = spark.range(40_000_000).where("id % 10000000 = 7").selectExpr("concat('k', id) AS id")
    found = table.read_keys(keys, version)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert [r.id for r in found.collect()] == ["k7"]


def test_a_large_bucket_is_written_by_several_tasks(spark, table, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with much data
    try:
        table.create(spark.range(2000).selectExpr("concat('k', id) AS id", "id AS value", "'n' AS note"), 1)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "table/data/step=0/bucket=0").glob("*.parquet"))) > 1 and table.read().count() == 2000
