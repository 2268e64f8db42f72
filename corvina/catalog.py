"""Every registered query of the library and the DuckDB SQL that it is compared with."""

from corvina.plans import analytics_queries, lookup_queries, relational_queries, retrieval_queries, service_queries, store_queries, streaming_queries, text_queries  # noqa: F401
from corvina.registry import ORACLES, QUERIES  # noqa: F401
