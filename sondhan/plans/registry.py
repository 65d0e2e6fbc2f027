"""All queries of the core library with their SQL twins."""

from __future__ import annotations

from sondhan.plans import curation, knowledge, retrieval, timestamps

MODULES = [curation, retrieval, knowledge, timestamps]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in MODULES for k, v in getattr(m, "ORACLE", {}).items()}
