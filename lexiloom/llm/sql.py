"""SQL counterparts of the queries, where SQL can express them whole."""

from __future__ import annotations

SQL: dict[str, str] = {}
