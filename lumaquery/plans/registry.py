"""All registered queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable


def modules() -> list:
    from . import cohorts, composite, corpus, design, details, hierarchy, reading, vectors

    return [corpus, hierarchy, reading, vectors, composite, design, details, cohorts]


def queries() -> dict[str, Callable]:
    return {k: q for m in modules() for k, (q, _) in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: sql for m in modules() for k, (_, sql) in m.QUERIES.items() if sql}
