"""All queries of the library and their SQL twins."""

from __future__ import annotations

from driftline.plans import announcements, more, panel, reports, stores, study, tables

_MODULES = [study, panel, more, reports, announcements, tables, stores]


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.ORACLES.items()}
