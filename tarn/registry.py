"""All queries of the core engine and their DuckDB equivalents."""

from __future__ import annotations

from tarn.plans import oracles, registered, stored, upkeep

QUERIES = registered.QUERIES | upkeep.QUERIES | stored.QUERIES
ORACLES = oracles.ORACLES | upkeep.ORACLES | stored.ORACLES
