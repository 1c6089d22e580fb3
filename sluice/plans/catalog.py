"""Registry of runnable queries and their checking SQL."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.plans.bindings import with_bindings

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``oracle`` may refer to bindings as ``{name}``."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice.")
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = with_bindings(oracle)
        return function

    return register


def stamp(moment: Column) -> Column:
    """Time as text, so that engines with other time types compare equal."""
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def listed(names: Column) -> Column:
    return F.array_join(names, ",")


def stamp_sql(moment: str) -> str:
    return f"strftime({moment}, '%Y-%m-%d %H:%M:%S.%f')"


def flags_sql(flags: list[tuple[str, str]]) -> str:
    """Names of the true conditions, comma separated."""
    cases = ", ".join(f"CASE WHEN {condition} THEN '{name}' END" for name, condition in flags)
    return f"array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), ',')"


def words_sql(text: str) -> str:
    return f"len(list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> ''))"


def blank_sql(text: str) -> str:
    return f"regexp_full_match({text}, '\\s*')"


def in_sql(value: str, domain) -> str:
    return f"{value} IN ({', '.join(repr(label) for label in domain)})"
