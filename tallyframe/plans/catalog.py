"""The queries of the analytics operators and their oracle SQL, by name."""

from __future__ import annotations

from tallyframe.plans import answers, artefacts, contents, cycles, details, numerics, runs, texts

MODULES = (runs, texts, numerics, cycles, artefacts, details, contents, answers)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
