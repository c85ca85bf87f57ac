"""All named queries over the shared tables."""

from __future__ import annotations

from . import crops, incremental, ingest, media, memory, pages, people, relational, sound, stored, story, streams  # noqa: F401
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
