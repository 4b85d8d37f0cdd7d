"""All queries of the engine by name, with the SQL that must give the same rows."""

from __future__ import annotations

from tessera.plans import answers, evaluation, retrieval, structure, tables, texts

_PARTS = (texts, structure, retrieval, answers, evaluation, tables)
QUERIES: dict = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
SQL: dict = {k: v for p in _PARTS for k, v in p.SQL.items()}
