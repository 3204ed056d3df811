"""A bounded memory of what is computed for single words, met by whole slices of text."""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import SLICE_BYTES, segments

#: Words that a worker remembers before it starts afresh (some 40 MB).
MAX_WORDS = 200_000
#: Bytes of text that are split at once: more text repeats more of its words.
TEXT_BYTES = 4 * SLICE_BYTES


class WordCache:
    """Maps words to runs of 32-bit integers; new words are computed in batches.

    `compute` takes a list of words and returns their runs as (sizes, values).
    The cache only saves work: it is emptied when full and results don't
    depend on it.
    """

    def __init__(self, compute: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], max_words: int = MAX_WORDS):
        self.compute, self.max_words = compute, max_words
        self._reset()

    def _reset(self) -> None:
        self.place: dict[str, int] = {"": 0}
        self.start, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.values, self.used = np.zeros(8192, np.int32), 0

    def _add(self, words: list[str]) -> None:
        sizes, values = self.compute(words)
        at, n, total = len(self.place), len(words), len(values)
        while len(self.size) < at + n:
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        while len(self.values) < self.used + total:
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        self.size[at : at + n] = sizes
        self.start[at : at + n] = self.used + np.cumsum(sizes) - sizes
        self.values[self.used : self.used + total] = values
        self.used += total
        self.place.update(zip(words, range(at, at + n)))

    def _found(self, words: list[str]) -> np.ndarray:
        """The places of distinct words."""
        if len(self.place) > self.max_words or self.used > 16 * self.max_words:
            self._reset()
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        if len(missing := np.flatnonzero(at < 0)):
            first = len(self.place)
            self._add([words[i] for i in missing.tolist()])
            at[missing] = np.arange(first, first + len(missing))
        return at

    def of_repeated(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, values) of the runs of words, which may repeat."""
        once = list(dict.fromkeys(words))
        place = dict(zip(once, self._found(once).tolist()))
        return self._gather(np.fromiter(map(place.__getitem__, words), np.int64, len(words)))

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[at]
        ends = np.cumsum(size)
        return size, self.values[np.repeat(self.start[at] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def _runs(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(text)
        coded = split.flatten().dictionary_encode()
        at = self._found(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy(zero_copy_only=False)]
        size, values = self._gather(at)
        before = np.append(0, np.cumsum(size))
        ptr = split.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        return np.diff(before[ptr - ptr[0]]), values

    def runs(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(integers of each row, all integers) of the words of a column without nulls.

        A row much longer than a slice is taken in parts that end at white space.
        """
        if len(text) == 1 and text.nbytes > 2 * TEXT_BYTES:
            parts = [self._runs(pa.array([part], pa.string()))[1] for part in segments(text[0].as_py().encode(), TEXT_BYTES)]
            return np.array([sum(map(len, parts))]), np.concatenate(parts)
        return self._runs(text)
