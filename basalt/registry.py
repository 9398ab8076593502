"""All queries of the ledger operators with their SQL."""

from __future__ import annotations

from .plans import derived, lookups, statistics, stored  # noqa: F401  they register themselves
from .plans.base import QUERIES, SQL

FLAGSHIP = QUERIES["multi_index_outcomes"]
