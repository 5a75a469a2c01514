"""Registered queries and their SQL, by area."""

from urbanflow.queries import distances, geometry, graphs, networks, results, tables, terrain

QUERIES: dict = {}
ORACLES: dict = {}
for _area in (geometry, networks, results, graphs, terrain, distances, tables):
    QUERIES |= _area.QUERIES
    ORACLES |= _area.ORACLES
