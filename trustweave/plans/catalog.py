"""All queries of the graph engine; importing the modules registers them."""

from trustweave.plans import queries_data, queries_expr, queries_lake, queries_trust  # noqa: F401
from trustweave.plans.registry import ORACLES, QUERIES  # noqa: F401
