"""All registered queries in one place."""

from estatelens.plans import (  # noqa: F401
    estate_queries, extraction_queries, job_queries, lineage_queries, mapping_queries, search_queries,
)
from estatelens.plans.registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "migration_report"
