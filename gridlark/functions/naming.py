"""Ids and unique names; metadata-sized, so on the driver."""

from __future__ import annotations

import itertools
from collections.abc import Collection, Iterator


def ids(start: int = 0, taken: Collection[int] = ()) -> Iterator[int]:
    """Integers from `start`, without those taken."""
    return (i for i in itertools.count(start) if i not in taken)


def unique_name(name: str, taken: Collection[str], start: int | None = None, brackets: bool = True) -> str:
    """The name, with the first free number if it is taken (or `start` is given)."""
    if start is None and name not in taken:
        return name
    for i in itertools.count(1 if start is None else start):
        new = f"{name} ({i})" if brackets else f"{name} {i}"
        if new not in taken:
            return new
    raise AssertionError
