"""Registered queries over the test tables, each next to the SQL that gives the same result."""

from . import aggregates, checks, files, joins, misc, nested, reconciliation

MODULES = (joins, reconciliation, aggregates, checks, nested, files, misc)


def queries():
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql():
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
