"""Token cost and retry delay."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice import fixed_values as V

TOKENS = "decimal(15,0)"
PRICE = "decimal(18,12)"
#: Tokens times prices, before they are divided by a million: up to 10^16, to the twelfth place.
MILLIONS = "decimal(28,12)"
COST = "decimal(38,12)"


def cost_expression(
    given: Column, produced: Column, cached: Column, price_in: Column, price_out: Column, price_cached: Column
) -> Column:
    """Exact decimal cost to the twelfth place; null where a price or count is unknown or the counts contradict each other.

    Counts may have 15 digits, prices 6 before and 12 behind the point.
    """
    used = F.coalesce(cached, F.lit(0)).try_cast(TOKENS)
    total = (
        (given.try_cast(TOKENS) - used) * price_in.cast(PRICE)
        + used * F.coalesce(price_cached.cast(PRICE), F.lit(0).cast(PRICE))
        + produced.try_cast(TOKENS) * price_out.cast(PRICE)
    )
    known = (
        given.isNotNull() & produced.isNotNull() & price_in.isNotNull() & price_out.isNotNull()
        & (F.least(given, produced, F.coalesce(cached, F.lit(0))) >= 0)
        & (F.coalesce(cached, F.lit(0)) <= given)
        & ((F.coalesce(cached, F.lit(0)) == 0) | price_cached.isNotNull())
    )
    # Multiplying by the exact decimal 0.000001 keeps the scale; division would re-derive it.
    return F.when(known, (total.try_cast(MILLIONS) * F.lit("0.000001").cast("decimal(7,6)")).cast(COST))


def token_cost(calls: DataFrame, pricing: DataFrame) -> DataFrame:
    """Calls with ``cost_usd``. One price row per model; Spark broadcasts it when its size allows."""
    priced = calls.join(pricing, "model", "left")
    return priced.withColumn(
        "cost_usd",
        cost_expression(
            F.col("input_tokens"), F.col("output_tokens"), F.col("cached_input_tokens"),
            F.col("input_per_million"), F.col("output_per_million"), F.col("cached_input_per_million"),
        ),
    ).drop("input_per_million", "output_per_million", "cached_input_per_million")


def backoff_delay(
    attempt: Column, base: float = V.BACKOFF_BASE_SECONDS, maximum: float = V.BACKOFF_MAX_SECONDS
) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt - 1), F.lit(maximum))


def known_sum(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0))
