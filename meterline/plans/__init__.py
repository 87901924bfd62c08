"""The registered queries by family, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from . import aggregates, analytics, flows, privacy, relations, scalars
from .common import plain

FAMILIES = (aggregates, relations, scalars, analytics, privacy, flows)


def _plain(f):
    return lambda spark, sf_dir: plain(f(spark, sf_dir))


QUERIES = {name: _plain(f) for family in FAMILIES for name, f in family.QUERIES.items()}
ORACLE_SQL = {name: sql for family in FAMILIES for name, sql in family.ORACLE_SQL.items() if sql}
