"""Ranges of consecutive items."""

from __future__ import annotations

from collections.abc import Iterator, Sequence


def slices(sizes: Sequence[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items with about ``most`` in sum, one item at least."""
    lo, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(sizes):
        yield lo, len(sizes)
