"""All registered queries."""

from sluice.plans import (  # noqa: F401
    masking_queries,
    contract_queries,
    request_queries,
    evaluation_queries,
    accounting_queries,
    language_queries,
    source_queries,
    streaming_queries,
    trial_queries,
)
from sluice.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
