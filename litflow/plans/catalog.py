"""All registered queries."""

from litflow.plans import (  # noqa: F401
    catalog_digest,
    catalog_graph,
    catalog_linkage,
    catalog_lists,
    catalog_scores,
    catalog_sources,
    catalog_streaming,
    catalog_trends,
)
from litflow.plans.registry import ORACLES, QUERIES  # noqa: F401
