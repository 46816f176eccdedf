"""All queries of the core, with the SQL that checks them."""

from __future__ import annotations

from tidewire.plans import base, formats, joins, learning, sets, statistics, stored, texts, vectors  # noqa: F401 - they register their queries

QUERIES = base.QUERIES
ORACLES = base.ORACLES
