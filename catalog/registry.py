from __future__ import annotations

from . import fixtures

CASES: dict = {}


def case(name: str, sql: str | None = None, needs: str = ""):
    """Register a query; ``needs`` names the fixture tables its SQL reads."""

    def keep(fn):
        if name in CASES:
            raise ValueError(f"query {name} is registered twice")
        CASES[name] = (fn, fixtures.with_tables(needs.split(), sql) if sql else None)
        return fn

    return keep
