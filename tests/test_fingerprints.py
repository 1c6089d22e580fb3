"""Table fingerprints under every kind of change, and pairing of runs against trying all pairs."""

import random
from decimal import Decimal

from pyspark.sql import functions as F

from sluice.operators.fingerprints import finish_digest, merge_digests, partial_digest, table_digest, table_drift, with_positions
from sluice.operators.guards import comparability
from sluice.operators.pairing import candidate_pairs

SCHEMA = "k long, text string, part string, value double, big decimal(20,4)"
ROWS = [(n, f"t{n}" if n % 5 else None, "ab"[n % 2], n / 3, Decimal(n) / 4) for n in range(200)]


def _digest(spark, rows, **more):
    return table_digest(spark.createDataFrame(rows, SCHEMA).repartition(5), **more).first().sha256


def test_any_change_shows_and_no_order_does(spark):
    whole = _digest(spark, ROWS)
    assert _digest(spark, list(reversed(ROWS))) == whole
    changed = [(*ROWS[0][:1], "other", *ROWS[0][2:])] + ROWS[1:]
    null = [(0, "", *ROWS[0][2:])] + ROWS[1:]  # an empty text is not a missing one
    for rows in (changed, null, ROWS[1:], ROWS + ROWS[:1], ROWS[1:] + ROWS[1:2], []):
        assert _digest(spark, rows) != whole
    assert len({_digest(spark, rows) for rows in (changed, null, ROWS[1:], ROWS + ROWS[:1], [])}) == 5
    swapped = [(0, ROWS[0][1], "a", ROWS[0][3], Decimal(1)), (1, ROWS[1][1], "b", ROWS[1][3], Decimal(0))] + ROWS[2:]
    assert _digest(spark, swapped) != whole  # the same cells in other rows


def test_parts_merge(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    one = merge_digests(partial_digest(rows.where("k < 20"), ("part",)).unionByName(partial_digest(rows.where("k >= 20"), ("part",))), ("part",))
    assert sorted(map(tuple, finish_digest(one).collect())) == sorted(map(tuple, table_digest(rows, ("part",)).collect()))


def test_order_shows_with_positions(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    placed = with_positions(rows.repartition(7), ["value", "k"])
    assert [r.k for r in placed.orderBy("position").collect()] == list(range(200))
    assert [r.position for r in placed.orderBy("position").collect()] == list(range(200))
    back = with_positions(rows.withColumn("down", -F.col("value")), ["down"]).drop("down")
    assert table_digest(placed, position="position").first().sha256 != table_digest(back, position="position").first().sha256
    assert table_digest(placed.drop("position")).first().sha256 == table_digest(back.drop("position")).first().sha256
    assert with_positions(rows.limit(0), ["k"]).count() == 0


def test_drift(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "name string, sha256 string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "name string, sha256 string")
    assert {r.name: r.drift for r in table_drift(old, new).collect()} == {"a": "same", "b": "changed", "c": "gone", "d": "new"}


def _runs(seed, count=120):
    rng = random.Random(seed)
    return [
        (f"r{n}", n, f"v{rng.randint(1, 4)}", f"p{rng.randint(1, 5)}", f"m{rng.randint(1, 2)}", "refs", f"x{rng.randint(1, 2)}", rng.random() < 0.8, rng.random() < 0.9, rng.choice([1, 1, 1, 1, 2]), rng.choice(["a", "a", "b"]))
        for n in range(count)
    ]


def test_pairs_are_comparable_and_the_rest_says_why(spark):
    names = ["run_id", "created_at", "prompt_version", "prompt_sha256", "messages_sha256", "references_sha256", "execution", "complete", "provenance_ok", "models", "model"]
    kinds = "string,long,string,string,string,string,string,boolean,boolean,long,string".split(",")
    for seed in range(3):
        rows = _runs(seed)
        runs = spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in zip(names, kinds))).repartition(4)
        pairs, rest = candidate_pairs(runs, hot_rows=3)
        pairs = pairs.collect()
        judged = comparability(spark.createDataFrame([(p.baseline, p.candidate) for p in pairs], "baseline string, candidate string"), runs.drop("created_at"))
        assert pairs and all(r.reasons == [] for r in judged.collect())
        held = {p.baseline for p in pairs} | {p.candidate for p in pairs}
        reasons = {r.run_id: r.reasons for r in rest.collect()}
        assert held | set(reasons) == {r[0] for r in rows} and not held & set(reasons)
        by_id = {r[0]: dict(zip(names, r)) for r in rows}
        blocks = {}
        for r in by_id.values():
            if r["complete"] and r["provenance_ok"] and r["models"] == 1:
                blocks.setdefault((r["messages_sha256"], r["execution"], r["model"]), []).append(r)
        expected = set()
        for members in blocks.values():
            versions = {}
            for r in sorted(members, key=lambda r: r["created_at"]):
                versions.setdefault(r["prompt_version"], []).append(r)
            order = list(versions.values())
            expected |= {(a[-1]["run_id"], b[-1]["run_id"]) for a, b in zip(order, order[1:]) if a[-1]["prompt_sha256"] != b[-1]["prompt_sha256"]}
        assert {(p.baseline, p.candidate) for p in pairs} == expected
        for run_id, why in reasons.items():
            r = by_id[run_id]
            own = [n for n, bad in (("incomplete", not r["complete"]), ("provenance", not r["provenance_ok"]), ("models_differ", r["models"] != 1)) if bad]
            assert why == own if own else why[0] in ("superseded", "alone", "same_prompt_text")
