"""Named queries over the supplied tables (see ``registry``)."""

from . import lifecycle, lookups, media, messages, mutations  # noqa: F401  (registers queries)
from .registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
