"""All registered queries. Importing the package fills the registry."""

from cargoscope.plans.catalog import ctes  # noqa: F401
from cargoscope.plans.catalog import (  # noqa: F401
    dependency_queries,
    flow_queries,
    macro_queries,
    monthly_queries,
    network_queries,
    source_queries,
    whatif_queries,
    year_queries,
)
from cargoscope.plans.catalog.base import QUERIES, SQL  # noqa: F401
