"""All registered queries of the library."""

from __future__ import annotations

from trackframe.plans import dataset_queries, metric_queries, sequence_queries, table_queries
from trackframe.plans.registry import ORACLES, QUERIES

MODULES = (metric_queries, dataset_queries, sequence_queries, table_queries)


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
