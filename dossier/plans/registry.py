"""All queries of the engine by name, and the SQL that must give the same rows."""

from __future__ import annotations

from . import documents, stored, structure, wiki

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (documents, structure, wiki, stored):
    for _name, (_query, _sql) in _part.CATALOGUE.items():
        QUERIES[_name] = _query
        if _sql is not None:
            ORACLE_SQL[_name] = _sql
