"""Column names that can't clash: Spark tells names apart by more than case, so these do, too."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def unlike(rows: DataFrame | Iterable[str], *names: str) -> list[str]:
    """A name for each of ``names`` that no column has, in whatever case."""
    taken = {c.casefold() for c in (rows.columns if isinstance(rows, DataFrame) else rows)}
    found = []
    for name in names:
        free = f"__{name}"
        while free.casefold() in taken:
            free += "_"
        taken.add(free.casefold())
        found.append(free)
    return found


def giving_way(columns: Iterable[str], added: Iterable[str]) -> list[str]:
    """The columns that stay where ``added`` are new: those of the same name, in whatever case, go."""
    new = {c.casefold() for c in added}
    return [c for c in columns if c.casefold() not in new]
