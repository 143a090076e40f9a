"""Names of working columns that a table does not have."""

from __future__ import annotations

from collections.abc import Sequence


def fresh(columns: Sequence[str], *wanted: str) -> list[str]:
    """The wanted names, each lengthened until no column has it (case ignored)."""
    taken, found = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found
