"""All queries over the driver tables and their DuckDB twins."""

from __future__ import annotations

from kvloom.plans import catalog, joins, lease, statistics, structured, trace

BOOKS = [trace.BOOK, statistics.BOOK, catalog.BOOK, lease.BOOK, joins.BOOK, structured.BOOK]
QUERIES: dict = {name: f for b in BOOKS for name, f in b.queries.items()}
ORACLES: dict = {name: sql for b in BOOKS for name, sql in b.oracles.items()}
