"""Registered queries of the library and the SQL they are checked against."""

from __future__ import annotations

from . import ingest, records, texts

QUERIES: dict = {}
ORACLES: dict = {}
for _part in (ingest, records, texts):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
