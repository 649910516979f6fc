"""The registered queries and the SQL that checks them.

Each module holds ``QUERIES`` (name -> function of session and table folder)
and ``SQL`` (name -> the same result in plain SQL).
"""

from workloads import aggregates, casts, exports, joins, limits, loads, profiles, projections, scans, streams

MODULES = (scans, exports, loads, projections, joins, aggregates, profiles, limits, casts, streams)


def all_queries():
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def all_sql():
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
