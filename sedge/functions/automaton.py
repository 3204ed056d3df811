"""Many patterns in one pass: a trie with failure links."""

from __future__ import annotations

import functools
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Automaton:
    """Finds all places of all `patterns` in a text in one pass, however many there are.

    States are prefixes of patterns; a failure link leads to the longest
    proper suffix of a state that is a state, an output link to the longest
    one that is a pattern.
    """

    def __init__(self, patterns: list[str]):
        self.patterns = patterns
        self.next: list[dict[str, int]] = [{}]
        self.pattern: list[int] = [-1]
        for i, pattern in enumerate(patterns):
            state = 0
            for c in pattern:
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.pattern.append(-1)
                state = self.next[state][c]
            if pattern and self.pattern[state] < 0:
                self.pattern[state] = i
        self.fail, self.output = [0] * len(self.next), [0] * len(self.next)
        open_ = deque(self.next[0].values())
        while open_:
            state = open_.popleft()
            for c, child in self.next[state].items():
                link = self.fail[state]
                while link and c not in self.next[link]:
                    link = self.fail[link]
                link = self.next[link].get(c, 0)
                self.fail[child] = link
                self.output[child] = link if self.pattern[link] >= 0 else self.output[link]
                open_.append(child)

    def matches(self, text: str) -> Iterator[tuple[int, int]]:
        """(end, pattern) of every place, in order of ends, longer patterns first."""
        state = 0
        for end, c in enumerate(text, 1):
            while state and c not in self.next[state]:
                state = self.fail[state]
            state = self.next[state].get(c, 0)
            found = state if self.pattern[state] >= 0 else self.output[state]
            while found:
                yield end, self.pattern[found]
                found = self.output[found]

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Places without overlaps: at each place from the left the longest."""
        longest: dict[int, int] = {}
        for end, i in self.matches(text):
            start = end - len(self.patterns[i])
            longest[start] = max(longest.get(start, 0), end)
        out, at = [], 0
        for start in sorted(longest):
            if start >= at:
                out.append((start, longest[start]))
                at = longest[start]
        return out


def folded(text: str) -> str:
    """Lower case and ё as е, a character for each character."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low.replace("ё", "е")


@functools.lru_cache(maxsize=1000)
def _of(tokens: tuple[str, ...]) -> Automaton:
    return Automaton([folded(t) for t in tokens])


def highlighted(text: str | None, tokens: list[str] | None) -> str | None:
    if not text or tokens is None or not any(tokens):
        return text
    out, at = [], 0
    for start, end in _of(tuple(tokens)).spans(folded(text)):
        out += [text[at:start], "<mark>", text[start:end], "</mark>"]
        at = end
    return "".join([*out, text[at:]])


@F.pandas_udf(T.StringType())
def _highlight(texts: pd.Series, tokens: pd.Series) -> pd.Series:
    return pd.Series([highlighted(t, None if w is None else list(w)) for t, w in zip(texts, tokens)], dtype=object)


def highlight_each(text: Column, tokens: Column) -> Column:
    """Mark each row's own `tokens` (an array) in its text: the longest from the left, е and ё alike, in any case."""
    return _highlight(text, tokens)


def variants_of(synonyms: dict[str, list[str]], first_only: bool, limit: int):
    """A function of a text: the text itself, then a variant for each alternative of a key that it contains."""
    keys = list(synonyms)
    automaton = Automaton(keys)

    def expand(text: str | None) -> list[str] | None:
        if text is None:
            return None
        tried = [text]
        for i in sorted({i for _, i in automaton.matches(text)}):
            tried += [text.replace(keys[i], s, 1 if first_only else -1) for s in synonyms[keys[i]][:2]]
            if len(dict.fromkeys(tried)) >= limit:
                break
        return list(dict.fromkeys(tried))[:limit]

    return expand


def synonym_variants(text: Column, synonyms: dict[str, list[str]], first_only: bool, limit: int) -> Column:
    """`variants_of` over a column; the automaton is built once for each batch of rows."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def expand(texts: pd.Series) -> pd.Series:
        return texts.map(variants_of(synonyms, first_only, limit))

    return expand(text)
