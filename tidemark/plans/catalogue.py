"""Import every plan module so that its queries register."""

from tidemark.plans import (  # noqa: F401
    chain_queries,
    config_queries,
    event_queries,
    evidence_queries,
    health_queries,
    investigation_queries,
    metric_queries,
    scalar_queries,
    signal_queries,
    source_queries,
    stream_queries,
)
from tidemark.plans.registry import QUERIES, SQL  # noqa: F401
