"""All queries outside the llm subpackage and their SQL."""

from jsonloom.plans import corpus, problems, reference

MODULES = [problems, corpus, reference]


def queries():
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql():
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
