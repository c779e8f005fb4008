"""All named queries and their SQL."""

from __future__ import annotations

from loomspan.plans import inventory  # noqa: F401  registers its queries
from loomspan.plans.catalog import QUERIES, SQL, flagship

__all__ = ["QUERIES", "SQL", "flagship"]
