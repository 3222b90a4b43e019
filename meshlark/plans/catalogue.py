"""All registered queries of the library, by family."""

from __future__ import annotations

from meshlark.plans import further_queries, graph_queries, kernel_queries, more_queries, relational_queries, similarity_queries, sketch_queries, solver_queries, spatial_queries, stats_queries, stream_queries  # noqa: F401
from meshlark.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
