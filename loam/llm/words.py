"""Words of many texts at once, on the UTF-8 bytes of an Arrow column."""

from __future__ import annotations

import numpy as np

from .common import SPACES

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the texts in one buffer.

    ``start``/``end``: byte place of each word in ``raw``; ``doc``: its text; ``first``: for each text the
    number of its first word (one entry more than texts); ``joined``: all words with one space after each,
    where word ``i`` lies at ``at[i]`` up to ``at[i] + end[i] - start[i]``.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool = False):
        solid = ~_IS_SPACE[raw]
        opens = solid.copy()
        opens[1:] &= ~solid[:-1]
        closes = solid.copy()
        closes[:-1] &= ~solid[1:]
        inner = offsets[(offsets > 0) & (offsets < len(raw))]
        opens[inner] = solid[inner]  # a text border also ends a word
        closes[inner - 1] = solid[inner - 1]
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        size = self.end - self.start
        self.at = np.cumsum(size + 1) - (size + 1)
        joined = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
        bytes_kept = raw[solid]
        joined[np.arange(len(bytes_kept)) + np.repeat(np.arange(len(size)), size)] = \
            _LOWER[bytes_kept] if lower else bytes_kept
        self.joined = joined
        self.size = size
