"""Named queries over the driver's tables."""

from __future__ import annotations

from . import aggregates, joins, ordering, scalars, scans, storage

MODULES = (scans, joins, aggregates, ordering, scalars, storage)
QUERIES = {name: fn for m in MODULES for name, fn in m.R.queries.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.R.oracles.items()}
