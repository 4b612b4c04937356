"""All registered queries and their SQL oracles."""

from __future__ import annotations

from paperloom.plans import queries_archive, queries_cases, queries_commands, queries_data, queries_days, queries_layout, queries_more, queries_objects, queries_redact, queries_text

_PARTS = (queries_text, queries_data, queries_more, queries_archive, queries_cases, queries_commands, queries_days, queries_layout, queries_objects, queries_redact)
QUERIES: dict = {k: q for p in _PARTS for k, q in p.QUERIES.items()}
ORACLE_SQL: dict = {k: s for p in _PARTS for k, s in p.ORACLE_SQL.items()}
