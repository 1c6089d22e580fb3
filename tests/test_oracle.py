"""All registered queries against their checking SQL on the smallest data."""

import ast
import pathlib

import __spark_entry__ as entry
from sluice.plans.registry import ORACLES, QUERIES
from tests.oracle_check import compare, connect

SMALL = "/root/testdata/sf0.001"


def test_every_query_equals_its_sql(spark):
    queries, oracles = QUERIES, ORACLES
    assert set(oracles) <= set(queries) <= set(entry.queries()) and set(oracles) <= set(entry.oracle_sql())
    connection = connect(SMALL)
    problems = {}
    for name, query in queries.items():
        problem, _, _ = compare(spark, connection, name, query, oracles.get(name), SMALL)
        if problem:
            problems[name] = problem[:300]
    assert not problems, problems


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_package_stays_off_the_driver():
    """No cross joins and no local checkpoints; the only rows that come in are a language profile of counted size."""
    base = pathlib.Path(entry.__file__).parent.joinpath("sluice")
    for path in (p for part in ("functions", "operators", "plans", "sources", "streaming") for p in base.joinpath(part).rglob("*.py")):
        called = [node.func.attr for node in ast.walk(ast.parse(path.read_text())) if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute)]
        assert not {"localCheckpoint", "crossJoin", "toPandas", "toLocalIterator"} & set(called), path
        assert called.count("toArrow") == (1 if path.name == "language.py" else 0), path
        # Bounded lists: buckets and manifests of a table, numbers of the batches just staged.
        assert called.count("collect") == {"buckets.py": 3, "intake.py": 1}.get(path.name, 0), path
