"""All queries by name, and the SQL that gives the same rows."""

from tracelake.plans import core, ingest, lineage, texts

_MODULES = (core, texts, lineage, ingest)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
