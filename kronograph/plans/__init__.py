"""All registered queries; importing this package registers them."""

from kronograph.plans import code_queries, event_queries, extra_queries, graph_queries, search_queries, stream_queries, temporal_queries, text_queries  # noqa: F401
from kronograph.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
