"""Pre-tokens of byte-level vocabularies and a bounded worker cache of their encodings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

CACHE_WORDS = 200_000


class WordCache:
    """Values of pre-tokens. What a batch of texts misses is computed in one call; beyond ``limit`` words the
    cache starts anew, so that its memory is bounded."""

    def __init__(self, compute: Callable[[list[str]], list], limit: int = CACHE_WORDS):
        self.compute, self.limit, self.known = compute, limit, {}

    def values(self, texts: list[list[str]]) -> Iterator[list]:
        known = self.known
        missing = set()
        for words in texts:
            missing.update(words)
        missing.difference_update(known)
        if missing:
            if len(known) + len(missing) > self.limit:
                known.clear()
                missing = {w for words in texts for w in words}
            todo = list(missing)
            known.update(zip(todo, self.compute(todo)))
        for words in texts:
            yield list(map(known.__getitem__, words))


def slices(texts: list[str], chars: int = 2_000_000) -> Iterator[list[str]]:
    """Consecutive texts of together about ``chars`` characters."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def id_bytes(ids) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return np.asarray(ids, dtype="<u4").tobytes()
