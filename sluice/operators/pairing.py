"""Which runs can be compared, found by blocking instead of by trying pairs.

Two runs can only be compared if they share their fixtures, their settings and their model. A digest of these is a
block; runs outside any block, or alone in theirs, get their reason from their own row. Within a block the runs of a prompt
version are represented by the latest one, by an aggregate, and each version is paired with the one before it. So the work
is an aggregate of all runs and a window over (block, version), never a join of runs with runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.functions.text import flag_list
from sluice.operators.skew import HOT_ROWS, attach

BLOCK = ("messages_sha256", "references_sha256", "execution", "model")


def blocked(runs: DataFrame) -> DataFrame:
    """Runs with their ``block``, null for those that can be compared with nothing, and ``reasons`` why not."""
    flags = [
        ("incomplete", ~F.coalesce("complete", F.lit(False))),
        ("provenance", ~F.coalesce("provenance_ok", F.lit(False))),
        ("models_differ", ~F.coalesce(F.col("models") == 1, F.lit(False))),
    ]
    digest = F.sha2(F.to_json(F.struct(*BLOCK), {"ignoreNullFields": "false"}), 256)
    judged = runs.withColumn("reasons", flag_list(*flags))
    return judged.withColumn("block", F.when(F.size("reasons") == 0, digest))


def candidate_pairs(runs: DataFrame, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """(pairs ``block, baseline, candidate``, the runs that are in none with their ``reasons``).

    ``runs``: run_id, created_at, prompt_version, prompt_sha256, messages_sha256, references_sha256, execution, complete,
    provenance_ok, models (distinct count) and model. Versions of a block follow each other by their first run; a version
    whose prompt text is that of the one before is not paired with it (``same_prompt_text``). A run that a later run of its
    version stands for is ``superseded``; one whose block has a single version is ``alone``.
    """
    rows = blocked(runs)
    latest = F.max(F.struct("created_at", "run_id", "prompt_sha256"))
    versions = rows.where(F.col("block").isNotNull()).groupBy("block", "prompt_version").agg(
        F.min("created_at").alias("since"), latest.alias("l"), F.count("*").alias("_rows")
    )
    order = W.partitionBy("block").orderBy("since", "prompt_version")  # one row for each prompt version of a block
    turned = versions.select(
        "block", "prompt_version", "_rows", "l.run_id", F.lag("l.run_id").over(order).alias("baseline"),
        F.lag("l.prompt_sha256").over(order).alias("_text"), F.col("l.prompt_sha256").alias("prompt_sha256"), F.lead("l.prompt_sha256").over(order).alias("_next"),
    )
    same = F.col("_text").eqNullSafe(F.col("prompt_sha256"))
    pairs = turned.where(F.col("baseline").isNotNull() & ~same).select("block", "baseline", F.col("run_id").alias("candidate"))

    follows, leads = F.col("_text").isNotNull(), F.col("_next").isNotNull()
    paired = (follows & (F.col("_text") != F.col("prompt_sha256"))) | (leads & (F.col("_next") != F.col("prompt_sha256")))
    why = F.when(~follows & ~leads, "alone").when(~paired, "same_prompt_text")
    verdicts = turned.select("block", "prompt_version", "_rows", F.col("run_id").alias("_stands"), why.alias("_why"))
    joined = attach(rows.where(F.col("block").isNotNull()), verdicts, ["block", "prompt_version"], ["run_id"], hot_rows=hot_rows)
    left = joined.withColumn("_why", F.when(F.col("run_id") != F.col("_stands"), "superseded").otherwise(F.col("_why")))
    left = left.where(F.col("_why").isNotNull()).select("run_id", F.array("_why").alias("reasons"))
    return pairs, rows.where(F.col("block").isNull()).select("run_id", "reasons").unionByName(left)
