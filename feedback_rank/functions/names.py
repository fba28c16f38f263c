"""Names for columns of our own beside those of a caller."""

from __future__ import annotations

from collections.abc import Iterable


def free_names(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores in front as keep it apart from those taken, whatever their case."""
    used, found = {name.lower() for name in taken}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        found.append(name)
    return found
