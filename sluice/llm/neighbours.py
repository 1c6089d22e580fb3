"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector is turned by a pseudo-rotation (three rounds of random signs and a fast Hadamard transform) and hashed to
the nearest signed axis. Each of ``tables`` tables has its own rotation; a query looks at its ``probes`` nearest axes of
each. Largest inner products become nearest unit vectors by one extra coordinate that fills every candidate up to the
largest norm. What the tables collect is reranked exactly, in double precision, on the original vectors.

Every distinct vector is indexed once, with as many of its smallest ids as a result can need. A bucket is joined in
blocks of bounded size on both sides. A query that found too few looks at all axes of one table, which is every vector.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.sources.workspace import settle

BLOCK = 4096


def hadamard(rows: np.ndarray) -> np.ndarray:
    """The normalised Walsh-Hadamard transform of each row (a power of two long), in n log n steps."""
    count, size = rows.shape
    half = 1
    while half < size:
        pairs = rows.reshape(count, size // (2 * half), 2, half)
        rows = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(count, size)
        half *= 2
    return rows / math.sqrt(size)


def rotated(rows: np.ndarray, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    for _ in range(3):
        rows = hadamard(rows * rng.choice(np.array([-1.0, 1.0]), rows.shape[1]))
    return rows


def axes(rows: np.ndarray, seed: int, size: int, best: int) -> np.ndarray:
    """The ``best`` nearest signed axes of each rotated row, nearest first: axis k, or size + k for its opposite."""
    turned = rotated(rows, seed)[:, :size]
    return np.argsort(-np.concatenate([turned, -turned], axis=1), axis=1, kind="stable")[:, :best]


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1) if values else np.zeros((0, 1))


def _padded(vectors: np.ndarray, filler: np.ndarray) -> np.ndarray:
    size = vectors.shape[1]
    out = np.zeros((len(vectors), 1 << size.bit_length()))
    out[:, :size], out[:, size] = vectors, filler
    return out


def _usable(vector: Column) -> Column:
    return vector.isNotNull() & F.exists(vector, lambda x: x != 0) & ~F.exists(
        vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    )


def nearest(
    vectors: DataFrame, is_query: Column, id_column: str = "vec_id", vector_column: str = "embedding",
    k: int = 20, tables: int = 12, probes: int = 12, seed: int = 17,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query row its ``k`` nearest found others, ties to the smaller id.

    ``is_query`` is a condition on ``id_column``. Candidates are all rows but the query's own. Vectors that are null,
    zero, or hold null or non-finite numbers take no part, nor do null ids; vectors of different lengths never meet.
    Rows that repeat an id and its vector count once; other vectors under the same id are candidates of their own,
    except to queries of that id. Fewer than ``k`` rows come back only if there are fewer candidates of the length.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"), is_query.alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & (F.size("vector") > 0) & _usable(F.col("vector"))).dropDuplicates(["id", "vector"])
    first = Window.partitionBy("vector").orderBy("id")
    few = rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)

    def packed(batches):
        for batch in batches:
            data = [np.array(v, np.float64).tobytes() for v in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary())], ["rep", "ids", "data"])

    kept = few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "ids", "vector")
    # Two vectors of one id would share a rep: the class is its smallest id and its vector's hash.
    classes = settle(
        kept.select("rep", "ids", "vector").mapInArrow(packed, "rep long, ids array<long>, data binary").select(
            F.xxhash64("rep", "data").alias("rep"), "ids", "data", (F.length("data") / 8).cast("int").alias("size"))
    )
    asking = settle(
        rows.where("asks").select("id", F.col("vector")).mapInArrow(
            lambda batches: (pa.RecordBatch.from_arrays([b.column(0), pa.array([np.array(v, np.float64).tobytes() for v in b.column(1).to_pylist()], pa.binary())], ["query_id", "data"]) for b in batches),
            "query_id long, data binary",
        ).join(classes.select("data", "rep"), "data").select("query_id", "rep")
    )
    sizes = {row["size"]: row for row in classes.groupBy("size").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("rows")).collect()}

    def norms(batches):
        for batch in batches:
            most = [float(np.sqrt((np.frombuffer(x) ** 2).sum())) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(most, pa.float64())], ["size", "norm"])

    longest = {r["size"]: r["norm"] for r in classes.select("size", "data").mapInArrow(norms, "size int, norm double").groupBy("size").agg(F.max("norm").alias("norm")).collect()}

    def hashed(query: bool, everywhere: bool = False):
        def run(batches):
            for batch in batches:
                sizes_here = batch.column(2).to_numpy()
                for size in np.unique(sizes_here).tolist():
                    some = batch.filter(pa.array(sizes_here == size))
                    matrix, reps = _matrix(some.column(1)), some.column(0).to_numpy()
                    norm = np.sqrt((matrix**2).sum(1))
                    if query:
                        unit = _padded(matrix / norm[:, None], np.zeros(len(matrix)))
                    else:
                        scaled = matrix / longest[size]
                        unit = _padded(scaled, np.sqrt(np.maximum(0.0, 1.0 - (scaled**2).sum(1))))
                    kept_axes = 1 << (size.bit_length() - 1)
                    for table in range(1 if everywhere else tables):
                        best = (2 * kept_axes if everywhere else min(probes, 2 * kept_axes)) if query else 1
                        code = axes(unit, seed + table, kept_axes, best)
                        bucket = (size * 1000 + table) * (4 * kept_axes) + code
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.repeat(reps, best)), pa.array(bucket.ravel().astype(np.int64)), some.column(1).take(pa.array(np.repeat(np.arange(len(reps)), best)))],
                            ["rep", "bucket", "data"],
                        )

        return run

    def best_of_block(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found = [[], [], []]
        if len(left) and len(right):
            queries, candidates = _matrix(left.column("data")), _matrix(right.column("data"))
            scores = queries @ candidates.T
            keep = min(k + 1, len(right))
            edge = np.partition(scores, len(right) - keep, axis=1)[:, len(right) - keep]
            asked, given = np.nonzero(scores >= (edge - 1e-9 * (1 + np.abs(edge)))[:, None])
            exact = (queries[asked] * candidates[given]).sum(1)
            found = [left.column("rep").to_numpy()[asked], right.column("rep").to_numpy()[given], exact]
        return pa.table({"query": pa.array(found[0], pa.int64()), "near": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    schema = "rep long, bucket long, data binary"
    index = classes.select("rep", "data", "size").mapInArrow(hashed(False), schema)
    queries = classes.join(asking.select("rep").distinct(), "rep").select("rep", "data", "size")

    def search(probing: DataFrame, index: DataFrame) -> DataFrame:
        def blocks(side: DataFrame, name: str) -> DataFrame:
            return side.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))

        # One row for each bucket, of which there are at most tables * 2 * axes for a vector length.
        cuts = settle(blocks(probing, "asked").join(blocks(index, "held"), "bucket"))

        def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
            part = F.pmod(F.xxhash64("rep"), F.col(own)).cast("int").alias(f"{own}_at")
            rest = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"{other}_at")
            return side.join(F.broadcast(cuts), "bucket").select("rep", "data", "bucket", part, rest)

        keys = ["bucket", "asked_at", "held_at"]
        pairs = dealt(probing, "asked", "held").groupBy(keys).cogroup(dealt(index, "held", "asked").groupBy(keys))
        pairs = pairs.applyInArrow(best_of_block, "query long, near long, score double").groupBy("query", "near").agg(F.max("score").alias("score"))
        best = Window.partitionBy("query").orderBy(F.desc("score"), "near_id")
        # Classes are ranked by the smallest id they offer, then opened into their ids.
        named = pairs.join(classes.select(F.col("rep").alias("near"), "ids"), "near")
        opened = named.select("query", "score", F.explode("ids").alias("near_id"))
        return opened.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).drop("place")

    found = settle(search(queries.mapInArrow(hashed(True), schema), index))
    enough = F.create_map(*[x for s, row in sizes.items() for x in (F.lit(s), F.lit(min(k + 1, row["rows"])))]) if sizes else F.lit(None)
    short = queries.join(found.groupBy(F.col("query").alias("rep")).agg(F.count("*").alias("n")), "rep", "left")
    short = settle(short.where(F.coalesce("n", F.lit(0)) < (enough[F.col("size")] if sizes else F.lit(0))).select("rep", "data", "size"))
    rest = search(short.mapInArrow(hashed(True, True), schema), classes.select("rep", "data", "size").mapInArrow(hashed(False), schema))
    together = found.join(short.select(F.col("rep").alias("query")), "query", "left_anti").unionByName(rest)
    answers = asking.join(together, asking["rep"] == together["query"]).where(F.col("query_id") != F.col("near_id"))
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "near_id")
    ranked = answers.groupBy("query_id", "near_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(rank))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("near_id").alias("vec_id"), "score")
