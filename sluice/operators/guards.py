"""Checks that have to pass before a run is resumed, scored, exported or compared."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice import fixed_values as V
from sluice.functions.text import flag_list
from sluice.operators.attempts import fatal_kinds
from sluice.operators.skew import HOT_ROWS, attach, attach_counted


def resume_pending(outcomes: DataFrame) -> DataFrame:
    """Outcomes as a resumed run sees them, with ``selected`` for the items it will process."""
    interrupted = F.col("state") == "running"
    state = F.when(interrupted, "interrupted_unknown").otherwise(F.col("state"))
    return outcomes.withColumn("state", state).withColumn("selected", F.col("state") == "pending")


def fatal_cutoff(items: DataFrame, spread_by: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Items (run_id, position, error_type) with ``started``.

    In submission order nothing after a run's first fatal failure starts. One minimum per run replaces a
    running window, so a run may hold any share of the rows.
    """
    fatal = F.coalesce(F.col("error_type").isin(*fatal_kinds()), F.lit(False))
    stops = items.groupBy("run_id").agg(
        F.min(F.when(fatal, F.col("position"))).alias("_stop"), F.count("*").alias("_rows")
    )
    rows = attach(items, stops, ["run_id"], spread_by, hot_rows=hot_rows)
    started = F.col("_stop").isNull() | (F.col("position") <= F.col("_stop"))
    return rows.withColumn("started", started).drop("_stop")


def run_complete(outcomes: DataFrame, expected_per_run: DataFrame) -> DataFrame:
    """Per run whether every expected ID is there once and succeeded."""
    per_id = outcomes.groupBy("run_id", "id").agg(
        F.count("*").alias("_rows"), F.bool_and(F.col("state") == "succeeded").alias("_ok")
    )
    per_run = per_id.groupBy("run_id").agg(
        F.count("*").alias("distinct_ids"), F.sum("_rows").alias("rows"), F.bool_and("_ok").alias("_ok")
    )
    complete = (F.col("distinct_ids") == F.col("expected_ids")) & (F.col("rows") == F.col("expected_ids")) & F.col("_ok")
    return expected_per_run.join(per_run, "run_id", "left").select(
        "run_id", "expected_ids", F.coalesce("distinct_ids", F.lit(0)).alias("distinct_ids"),
        F.coalesce(complete, F.lit(False)).alias("complete"),
    )


def single_version(outcomes: DataFrame) -> DataFrame:
    """Per run the number of prompt versions and models among its results, and whether each is single."""
    done = F.col("state") == "succeeded"
    distinct = outcomes.where(done).groupBy("run_id").agg(
        F.countDistinct("version_prompt").alias("versions"), F.countDistinct("model").alias("models")
    )
    return distinct.withColumn("single", (F.col("versions") <= 1) & (F.col("models") == 1))


def _differs(name: str) -> Column:
    return ~F.col(f"run.{name}").eqNullSafe(F.col(f"now.{name}"))


def resume_guard(runs: DataFrame, current: DataFrame) -> DataFrame:
    """Recorded run headers against the provenance a resumed process would have; ``reasons`` empty = resumable."""
    flags = [
        ("schema_version", ~F.col("run.schema_version").eqNullSafe(F.lit(V.ARTIFACT_VERSION))),
        ("run_id", F.col("now.run_id").isNull()),
        *[
            (name, F.col("now.run_id").isNotNull() & _differs(name))
            for name in ("prompt_version", "inputs", "execution", "item_count", "item_fingerprint")
        ],
        ("checkpoint_state", F.coalesce(F.col("run.bad_states") > 0, F.lit(False))),
        ("checkpoint_provenance", F.coalesce(F.col("run.bad_provenance") > 0, F.lit(False))),
    ]
    joined = runs.alias("run").join(current.alias("now"), F.col("run.run_id") == F.col("now.run_id"), "left")
    return joined.select(F.col("run.run_id").alias("run_id"), flag_list(*flags).alias("reasons"))


def outcome_digest(outcomes: DataFrame) -> DataFrame:
    """Per run: item count, an order-sensitive ID fingerprint and counts of unusable checkpoints.

    The fingerprint is a sum of per-row hashes of (position, id): it merges across tasks in any order and
    still changes when an ID moves.
    """
    wrong = (F.col("state") == "succeeded") & ~(
        F.col("classification_id").eqNullSafe(F.col("id"))
        & F.col("metadata_version").eqNullSafe(F.col("prompt_version"))
    )
    return outcomes.groupBy("run_id").agg(
        F.count("*").alias("item_count"),
        F.sum(F.xxhash64("position", "id").cast("decimal(38,0)")).alias("item_fingerprint"),
        F.count(F.when(~F.coalesce(F.col("state").isin(*V.OUTCOME_STATES), F.lit(False)), 1)).alias("bad_states"),
        F.count(F.when(wrong, 1)).alias("bad_provenance"),
    )


def item_digest(items: DataFrame) -> DataFrame:
    """Count and fingerprint of the items (run_id, position, id) that a run plans, as ``outcome_digest`` has them."""
    return items.groupBy("run_id").agg(
        F.count("*").alias("item_count"), F.sum(F.xxhash64("position", "id").cast("decimal(38,0)")).alias("item_fingerprint")
    )


def drift_guard(recorded: DataFrame, current: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(run_id, name, sha256) against current (name, sha256): the inputs that changed or disappeared.

    Most runs record the same few inputs, so popular names are spread out.
    """
    now = current.select("name", F.col("sha256").alias("_now"))
    joined = attach_counted(recorded, now, ["name"], ["run_id"], hot_rows)
    return joined.where(~F.col("sha256").eqNullSafe(F.col("_now"))).select(
        "run_id", "name", F.when(F.col("_now").isNull(), "unknown_input").otherwise("changed").alias("drift")
    )


def comparability(pairs: DataFrame, runs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Requested (baseline, candidate) pairs with the reasons why they cannot be compared.

    ``runs``: run_id, prompt_version, prompt_sha256, messages_sha256, references_sha256, execution, complete,
    provenance_ok, models (distinct count) and model. One run may be the baseline of most pairs.
    """
    base = runs.select(F.col("run_id").alias("baseline"), *[F.col(name).alias(f"b_{name}") for name in runs.columns])
    cand = runs.select(F.col("run_id").alias("candidate"), *[F.col(name).alias(f"c_{name}") for name in runs.columns])
    joined = attach_counted(pairs, base, ["baseline"], ["candidate"], hot_rows)
    joined = attach_counted(joined, cand, ["candidate"], ["baseline"], hot_rows)

    def same(name: str) -> Column:
        return F.col(f"b_{name}").eqNullSafe(F.col(f"c_{name}"))

    known = F.col("b_run_id").isNotNull() & F.col("c_run_id").isNotNull()
    flags = [
        ("unknown_run", ~known),
        ("same_prompt_version", known & same("prompt_version")),
        ("same_prompt_text", known & same("prompt_sha256")),
        ("fixtures_differ", known & ~(same("messages_sha256") & same("references_sha256"))),
        ("settings_differ", known & ~same("execution")),
        ("incomplete", known & ~(F.col("b_complete") & F.col("c_complete"))),
        ("provenance", known & ~(F.col("b_provenance_ok") & F.col("c_provenance_ok"))),
        ("models_differ", known & ~((F.col("b_models") == 1) & (F.col("c_models") == 1) & same("model"))),
    ]
    return joined.select("baseline", "candidate", flag_list(*flags).alias("reasons"))
