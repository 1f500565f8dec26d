"""Queries over the driver's tables, by operator, and the SQL that must give the same rows."""

from __future__ import annotations

from . import catalog, evidence, folds, scans, streams, writes

QUERIES = scans.QUERIES | folds.QUERIES | evidence.QUERIES | catalog.QUERIES | streams.QUERIES | writes.QUERIES
ORACLES = scans.ORACLES | folds.ORACLES | evidence.ORACLES | catalog.ORACLES | streams.ORACLES | writes.ORACLES
