"""Registered queries of the engine and their SQL."""

from __future__ import annotations

from lattica.plans import answering, declaring, describing, linking, reporting, resolving, ruling, scanning, searching

QUERIES: dict = {}
ORACLES: dict = {}
for _part in (linking, describing, searching, reporting, ruling, answering, scanning, resolving, declaring):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
