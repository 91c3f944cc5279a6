"""Imports every query module, so that the registry is complete."""

from __future__ import annotations

from curatrix.plans import (  # noqa: F401
    access_queries,
    compliance_queries,
    contract_queries,
    graph_queries,
    linking_queries,
    matching_queries,
    product_queries,
    quality_queries,
    search_queries,
    source_queries,
    summary_queries,
)
from curatrix.plans.registry import QUERIES, Data, oracle_text


def queries():
    return {n: (lambda spark, sf_dir, q=q: q.run(Data(spark, sf_dir))) for n, q in QUERIES.items()}


def oracle_sql():
    return {n: oracle_text(q.sql) for n, q in QUERIES.items() if q.sql}
