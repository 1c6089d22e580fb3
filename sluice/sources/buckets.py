"""A table in hash buckets that is merged when it is read.

Rows of a key always stand in the same bucket. A change is written as a delta: whole new rows of the changed keys, in the
folders of their buckets only. A reader takes, for each bucket that it needs, the bucket's base and its deltas, the latest
row of a key winning. A bucket with many deltas is compacted into a new base. Nothing is changed in place: every version is
a manifest that lists, bucket by bucket, the folders that make it up, and older versions stay readable.

A manifest has at most (buckets x (deltas allowed + 1)) rows, whatever the size of the table; it is what the driver holds.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.sources.workspace import settle

BUCKETS, MOST_DELTAS = 64, 4
_MANIFEST = "bucket int, step int, place int, buckets int"


class BucketTable:
    """``path/manifest/version=N`` and ``path/data/step=S/bucket=B``; step S is written by the change that makes version S."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str = "id"):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key

    # -- versions

    def _manifest(self, version: int) -> list[tuple[int, int, int, int]]:
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/version={version}").collect()
        return sorted((r.bucket, r.place, r.step, r.buckets) for r in rows)

    def _commit(self, version: int, parts: dict[int, list[int]], buckets: int) -> int:
        """Write the manifest last: until then the new folders belong to no version."""
        rows = [(b, step, place, buckets) for b, steps in parts.items() for place, step in enumerate(steps)]
        rows = rows or [(-1, -1, 0, buckets)]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")
        return version

    def _parts(self, version: int) -> tuple[dict[int, list[int]], int]:
        """Steps of each bucket, base first, and the number of buckets."""
        parts, buckets = defaultdict(list), BUCKETS
        for bucket, _, step, buckets in self._manifest(version):
            if bucket >= 0:
                parts[bucket].append(step)
        return dict(parts), buckets

    def latest(self) -> int:
        """Highest committed version, from the folder names that Spark lists."""
        names = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{self.path}/manifest")
        return names.select(F.max(F.regexp_extract("path", r"version=(\d+)/", 1).cast("int"))).first()[0]

    # -- writing

    def bucket_of(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")

    def _write(self, rows: DataFrame, step: int, buckets: int) -> list[int]:
        """The rows in their buckets' folders; gives the buckets that got any."""
        path = f"{self.path}/data/step={step}"
        # One row for each key, so hash buckets are even. A bucket is written by as many tasks as the session has shuffle
        # partitions for it; of a small change adaptive execution makes one task and a file for each bucket.
        slices = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // buckets)
        part = F.pmod(F.xxhash64(F.lit(1), self.key), F.lit(slices))
        placed = rows.select(*self.schema.names).withColumn("bucket", self.bucket_of(buckets))
        placed.repartition("bucket", part).write.partitionBy("bucket").mode("overwrite").parquet(path)
        written = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(path)
        return [r[0] for r in written.select("bucket").distinct().collect()]  # at most as many as there are buckets

    def create(self, rows: DataFrame, buckets: int = BUCKETS) -> int:
        """Version 0; ``rows`` has one row for each key."""
        return self._commit(0, {b: [0] for b in self._write(rows, 0, buckets)}, buckets)

    def put(self, changed: DataFrame, version: int) -> int:
        """Version + 1: the rows of ``changed`` (one for each key) replace or add theirs. Repeated, it writes the same again."""
        parts, buckets = self._parts(version)
        for bucket in self._write(changed, version + 1, buckets):
            parts.setdefault(bucket, []).append(version + 1)
        return self._commit(version + 1, parts, buckets)

    def compact(self, version: int, most_deltas: int = MOST_DELTAS) -> int:
        """Version + 1 with a new base for every bucket that has more deltas than that; the same version if none has."""
        parts, buckets = self._parts(version)
        full = [b for b, steps in parts.items() if len(steps) > most_deltas + 1]
        if not full:
            return version
        self._write(self.read(version, full), version + 1, buckets)
        return self._commit(version + 1, parts | {b: [version + 1] for b in full}, buckets)

    def carry(self, version: int) -> int:
        """Version + 1 that is the same as the version."""
        return self._commit(version + 1, *self._parts(version))

    # -- reading

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows of a version (the latest), of all buckets or ``only`` some.

        Buckets without deltas are read as they are; in the others the latest row of a key wins, by an aggregate of the
        deltas alone: rows of the base are only checked against the deltas' keys.
        """
        parts, _ = self._parts(self.latest() if version is None else version)
        chosen = {b: steps for b, steps in parts.items() if only is None or b in set(only)}
        plain = self._folders([(steps[0], b) for b, steps in chosen.items() if len(steps) == 1])
        bases = self._folders([(steps[0], b) for b, steps in chosen.items() if len(steps) > 1])
        deltas = self._folders([(step, b) for b, steps in chosen.items() for step in steps[1:]])
        found = [] if plain is None else [plain.select(*self.schema.names)]
        if deltas is not None:
            newest = deltas.groupBy(self.key).agg(F.max_by(F.struct(*self.schema.names), "_step").alias("_row"))
            found.append(bases.join(newest.select(self.key), self.key, "left_anti").select(*self.schema.names))
            found.append(newest.select("_row.*"))
        whole = found[0] if found else self.spark.createDataFrame([], self.schema)
        for part in found[1:]:
            whole = whole.unionByName(part)
        return whole

    def _folders(self, places: list[tuple[int, int]]) -> DataFrame | None:
        if not places:
            return None
        paths = [f"{self.path}/data/step={step}/bucket={bucket}" for step, bucket in places]
        whole = self.spark.read.schema(self.schema).parquet(*paths)
        return whole.withColumn("_step", F.regexp_extract(F.col("_metadata.file_path"), r"/step=(\d+)/", 1).cast("int"))

    def touched(self, keys: DataFrame, version: int) -> list[int]:
        """Buckets of the given keys (a column named like the key); at most as many as there are buckets."""
        _, buckets = self._parts(version)
        return [r[0] for r in keys.where(F.col(self.key).isNotNull()).select(self.bucket_of(buckets).alias("b")).distinct().collect()]

    def read_keys(self, keys: DataFrame, version: int) -> DataFrame:
        """Rows of the given keys, from their buckets only.

        The keys are written down first: of few, Spark sees the size and sends them to the buckets' rows, which stay where they are.
        """
        named = settle(keys.select(self.key).where(F.col(self.key).isNotNull()).distinct())
        return self.read(version, self.touched(named, version)).join(named, self.key, "left_semi").select(*self.schema.names)

    def rewritten(self, version: int) -> int:
        """How many buckets the change that made a version wrote."""
        parts, _ = self._parts(version)
        return sum(version in steps for steps in parts.values())
