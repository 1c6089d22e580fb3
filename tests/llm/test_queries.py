"""The registered queries of this part: complete, importable beside the others, equal to their SQL on the smallest data."""

import ast
import pathlib

import __spark_entry__ as entry
from sluice.llm import queries
from tests.oracle_check import compare, connect

SMALL = "/root/testdata/sf0.001"


def test_every_query_equals_its_sql(spark):
    assert {name.split("_")[0] for name in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries()) and set(queries.ORACLES) <= set(queries.QUERIES)
    connection = connect(SMALL)
    for name, sql in queries.ORACLES.items():
        problem, _, _ = compare(spark, connection, name, queries.QUERIES[name], sql, SMALL)
        assert problem is None, (name, problem)


def test_nothing_else_imports_this_part():
    base = pathlib.Path(entry.__file__).parent.joinpath("sluice")
    for path in base.rglob("*.py"):
        text = path.read_text()
        called = {node.func.attr for node in ast.walk(ast.parse(text)) if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute)}
        assert not {"localCheckpoint", "crossJoin", "toPandas", "toLocalIterator"} & called, path
        assert path.parent.name == "llm" or "sluice.llm" not in text, path
