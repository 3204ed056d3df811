"""Token counts of greedy longest-match word pieces in linear time.

The vocabulary becomes a trie with failure links (Song et al., "Fast WordPiece
Tokenization", 2021): where a word leaves the trie, the link of the current
node leads to the node of what is left after the greedy pieces so far, and the
node holds how many tokens those pieces count.  So a word's length in tokens
is a sum of precomputed numbers, and no piece is built.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import text_batches
from .word_cache import TEXT_BYTES, WordCache
from .words import slices, strings


class LongestMatch:
    """Counts the tokens of words.

    `pieces` are the vocabulary; a word is matched after `prefix`.  Where no
    piece matches, one character counts as its UTF-8 bytes (byte fallback).
    """

    def __init__(self, pieces: list[str], prefix: str = ""):
        self.prefix = prefix
        self.next: list[dict[str, int]] = [{}]
        weight = {p: 1 for p in pieces if p}
        for c in set("".join(weight)):
            weight.setdefault(c, len(c.encode()))
        tokens = {}
        for piece, w in weight.items():
            node = 0
            for c in piece:
                if (to := self.next[node].get(c)) is None:
                    to = self.next[node][c] = len(self.next)
                    self.next.append({})
                node = to
            tokens[node] = w
        self.fail, self.popped = [0] * len(self.next), [0] * len(self.next)
        level = [0]
        while level:
            below = []
            for u in level:
                for c, v in self.next[u].items():
                    if v in tokens:
                        self.popped[v] = tokens[v]
                    else:  # characters are tokens, so links of deeper nodes exist
                        count, z = self.popped[u], self.fail[u]
                        while c not in self.next[z]:
                            count += self.popped[z]
                            z = self.fail[z]
                        self.fail[v], self.popped[v] = self.next[z][c], count
                    below.append(v)
            level = below

    def count(self, word: str) -> int:
        step, fail, popped = self.next, self.fail, self.popped
        total = node = 0
        for c in self.prefix + word:
            while (to := step[node].get(c)) is None:
                if not node:
                    total += len(c.encode())
                    to = 0
                    break
                total += popped[node]
                node = fail[node]
            node = to
        while node:
            total += popped[node]
            node = fail[node]
        return total


def sentence_pieces(model_file: str) -> list[str]:
    """The ordinary pieces of a public sentencepiece model file."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_file)
    odd = lambda i: model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not odd(i)]


@functools.lru_cache(maxsize=2)
def _cache(pieces: tuple[str, ...], prefix: str) -> WordCache:
    """One for each worker process and vocabulary."""
    automaton = LongestMatch(list(pieces), prefix)
    return WordCache(lambda words: (np.ones(len(words), np.int64), np.fromiter(map(automaton.count, words), np.int32, len(words))))


def _counts(vocabulary, prefix: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _cache(vocabulary.value, prefix)
        for batch in batches:
            text = strings(batch.column("text"))
            for at, rows in slices(text, TEXT_BYTES):
                n_words, counts = cache.runs(text.slice(at, rows))
                n_tokens = np.diff(np.append(0, np.cumsum(counts, dtype=np.int64))[np.append(0, np.cumsum(n_words))])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, rows), pa.array(n_words), pa.array(n_tokens)], names=["doc_id", "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, pieces: list[str], id_col: str = "doc_id", text_col: str = "text", prefix: str = "▁") -> DataFrame:
    """doc_id, n_words, n_tokens of every row of `docs`.

    Words are runs of characters other than space and U+0009..U+000D, taken
    unchanged; n_tokens adds up their greedy longest-match pieces.  Null and
    empty texts have none.  Repeated rows are returned as often as they come, and
    an empty table gives an empty result.  A text of any length is counted
    whole, in parts that end at white space.  Other columns are not returned.
    The vocabulary (its size is fixed, not the corpus's) is broadcast.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    text_batches(docs.sparkSession)
    vocabulary = docs.sparkSession.sparkContext.broadcast(tuple(pieces))
    return docs.mapInArrow(_counts(vocabulary, prefix), "doc_id long, n_words long, n_tokens long")
