"""Named queries over the driver tables, each with the SQL that must give the same rows."""

from sessionlab.catalog import (  # noqa: F401
    aggregate_queries,
    cleaning_queries,
    flow_queries,
    join_queries,
    model_queries,
    nested_queries,
    scalar_queries,
    source_queries,
    window_queries,
)
from sessionlab.catalog.registry import ORACLES, QUERIES  # noqa: F401
