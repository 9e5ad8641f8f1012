"""All registered queries of the engine's own operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from . import asked, clinical, evaluation, more, search

FAMILIES = (clinical, evaluation, search, more, asked)


def queries() -> dict[str, Callable]:
    return {name: f for family in FAMILIES for name, (f, _) in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, (_, sql) in family.QUERIES.items() if sql}
