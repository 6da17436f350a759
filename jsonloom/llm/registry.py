"""The queries of this subpackage and their SQL."""

from jsonloom.llm import queries as _queries

MODULES = [_queries]


def queries():
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql():
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
