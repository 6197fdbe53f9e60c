"""All queries by name, with their SQL."""

from __future__ import annotations

from . import document_queries, layout_queries, package_queries, record_queries, relational, stream_queries, text_queries

MODULES = (text_queries, relational, document_queries, layout_queries, record_queries, package_queries, stream_queries)


def merged(*tables: dict) -> dict:
    """One table of all; a name that stands in two of them is an error, as one of the two would be lost."""
    out: dict = {}
    for t in tables:
        if both := out.keys() & t.keys():
            raise ValueError(f"registered twice: {sorted(both)}")
        out |= t
    return out


QUERIES: dict = merged(*(m.QUERIES for m in MODULES))
ORACLE_SQL: dict = merged(*(m.ORACLE_SQL for m in MODULES))
