"""Registered queries and their SQL."""

from tessera.plans import discovery, extensions, reference

QUERIES = reference.QUERIES | discovery.QUERIES | extensions.QUERIES
ORACLE_SQL = reference.ORACLE_SQL | discovery.ORACLE_SQL | extensions.ORACLE_SQL
