"""All queries of the catalogue."""

from __future__ import annotations

from . import derived as _derived  # noqa: F401  registers its queries
from . import extraction as _extraction  # noqa: F401
from . import store as _store  # noqa: F401
from .queries import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
