"""Registered queries and the SQL that each must agree with."""

from . import images, ledgers, runs, stages, texts, timelines

_MODULES = (timelines, images, texts, runs, stages, ledgers)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
