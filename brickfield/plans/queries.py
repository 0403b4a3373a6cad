"""Named queries over the driver's tables, each beside its SQL."""

from __future__ import annotations

from brickfield.plans import array_queries, graph_queries, label_queries, lattice_queries, location_queries, volume_queries

MODULES = (array_queries, label_queries, graph_queries, location_queries, volume_queries, lattice_queries)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
FLAGSHIP = label_queries.scan_affinities
