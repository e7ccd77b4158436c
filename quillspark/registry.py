"""All registered queries of the library, with the SQL they are held against."""

from __future__ import annotations

from quillspark import learned, round_trips, trained  # noqa: F401  register their queries
from quillspark.queries import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
