"""All queries of the core and their SQL."""

from __future__ import annotations

from corvane.plans import packed_queries, prep_queries, report_queries, search_queries

MODULES = [packed_queries, prep_queries, search_queries, report_queries]


def queries() -> dict:
    out: dict = {}
    for m in MODULES:
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= getattr(m, "SQL", {})
    return out


def entry(spark, sf_dir):
    """The flagship query: hybrid retrieval, graph-aware ranking and explanations of the benchmark's queries."""
    return queries()["hybrid_explained"](spark, sf_dir)
