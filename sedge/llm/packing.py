"""Packing documents into fixed-length sequences, shortest pack first.

Each document is tokenised once and cut into pieces of at most one sequence;
a piece keeps its length and a checksum of its ids.  The histogram of piece
lengths (at most one row for each length) goes to the driver, where lengths
are placed longest first into the pattern of packs with most room left,
updating how often each pattern occurs (Krell et al., "Efficient Sequence
Packing", 2021).  Patterns then join back to the pieces by their rank among
the pieces of their length.
"""

from __future__ import annotations

import functools
import itertools
import json
import unicodedata
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize, text_batches
from .word_cache import TEXT_BYTES, WordCache
from .words import slices, strings

#: Rows that one task ranks; longer runs of one length are split by a hash.
RANKED = 10_000

#: The tokenizer's own split of a word (fixed value).
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: How byte-level vocabularies write bytes that aren't printable: as U+0100 and on, in order.
_BYTES = {b: 256 + n for n, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}
#: Words of characters below this bound, signs that may begin special tokens
#: and apostrophes (contractions) excepted, are split here; the tokenizer's
#: normaliser only lower-cases them.  Other words go to the tokenizer whole.
_BOUND = 0x250
_LETTER, _DIGIT, _SIGN, _ODD = range(4)


@functools.cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """(class, lower case) of the characters below _BOUND; the last row stands for all others."""
    kinds = np.full(_BOUND + 1, _ODD, dtype=np.int8)
    lower = np.arange(_BOUND + 1, dtype=np.uint32)
    for c in range(0x21, _BOUND):
        if chr(c) in "'<|>" or 0x7F <= c <= 0xA0 or c == 0x130:
            continue
        major = unicodedata.category(chr(c))[0]
        kinds[c] = {"L": _LETTER, "N": _DIGIT}.get(major, _SIGN)
        lower[c] = ord(chr(c).lower())
    return kinds, lower


def _joined(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(map(len, lists), np.int64, len(lists)), np.fromiter(itertools.chain.from_iterable(lists), np.int32)


class _Ids:
    """Ids of words, from the remembered ids of their parts where the tokenizer's rule is the known one."""

    def __init__(self, tokenizer):
        self.tokenizer, self.model = tokenizer, tokenizer.model
        rule = json.loads(tokenizer.to_str())
        split = str((rule.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex"))
        kinds = [n.get("type") for n in (rule.get("normalizer") or {}).get("normalizers", [])]
        self.known_rule = split == _SPLIT and kinds == ["NFC", "Replace", "Lowercase"]
        self.parts = WordCache(self._of_parts)

    def _of_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        written = (p if p.isascii() else p.encode().decode("latin-1").translate(_BYTES) for p in parts)
        tokenize = self.model.tokenize
        return _joined([[t.id for t in tokenize(p)] for p in written])

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        kinds, lower = _characters()
        length = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(length) - length
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        near = np.minimum(code, np.uint32(_BOUND))
        kind = kinds[near]
        simple = (np.maximum.reduceat(kind, first) < _ODD) if self.known_rule else np.zeros(len(words), dtype=bool)

        odd_size, odd_ids = _joined([self.tokenizer.encode(words[i], add_special_tokens=False).ids for i in np.flatnonzero(~simple).tolist()])
        # a part begins where the class changes, at each digit, and with each word
        begins = (kind == _DIGIT) | np.append(True, kind[1:] != kind[:-1])
        begins[first] = True
        held = np.repeat(simple, length)
        begins, letters = begins[held], lower[near[held]]
        spaced = np.full(len(letters) + int(begins.sum()), 32, dtype=np.uint32)
        spaced[np.arange(len(letters)) + np.cumsum(begins)] = letters
        parts = spaced.tobytes().decode("utf-32-le").split(" ")[1:]
        part_size, part_ids = self.parts.of_repeated(parts)
        owner = np.repeat(np.arange(len(words)), length)[held][begins]

        size = np.bincount(owner, weights=part_size, minlength=len(words)).astype(np.int64)
        size[~simple] = odd_size
        ids = np.zeros(int(size.sum()), np.int32)
        from_parts = np.repeat(simple, size)
        ids[from_parts], ids[~from_parts] = part_ids, odd_ids
        return size, ids


@functools.lru_cache(maxsize=2)
def encoder(tokenizer_json: str) -> WordCache:
    """Token ids of words of a tokenizer that never joins text across white space.

    One for each worker process, so its tasks share what is remembered.
    """
    from tokenizers import Tokenizer

    return WordCache(_Ids(Tokenizer.from_str(tokenizer_json)).of)


def _pieces(tokenizer_json: str, length: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer_json)
        for batch in batches:
            text = strings(batch.column("text"))
            for row, rows in slices(text, TEXT_BYTES):
                size, ids = words.runs(text.slice(row, rows))
                total = size + 1
                stop = np.cumsum(total)
                whole = np.full(int(stop[-1]), end_id, dtype="<u4")
                own = np.ones(len(whole), dtype=bool)
                own[stop - 1] = False
                whole[own] = ids
                many = -(-total // length)
                owner = np.repeat(np.arange(rows), many)
                start = (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)) * length
                size = np.minimum(total[owner] - start, length)
                first = (stop - total)[owner] + start
                held = memoryview(whole).cast("B")
                crc = [zlib.crc32(held[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + size).tolist())]
                columns = [batch.column("doc_id").slice(row, rows).take(pa.array(owner)), *(pa.array(x, pa.int64()) for x in (start, size, crc, total[owner]))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        pa.default_memory_pool().release_unused()  # the worker lives on in later stages

    return run


def shortest_pack_first(histogram: dict[int, int], limit: int) -> list[tuple[list[int], int]]:
    """(lengths of a pack, how many such packs) that place every piece once.

    Lengths go longest first; each goes to the packs with most room left, or
    opens new packs if none has room.
    """
    by_room: dict[int, list[tuple[list[int], int]]] = {}
    for length in sorted(histogram, reverse=True):
        left, room = histogram[length], limit
        while left:
            room = max((r for r in by_room if length <= r <= room), default=-1)
            if room < 0:
                by_room.setdefault(limit - length, []).append(([length], left))
                break
            pack, count = by_room[room].pop()
            used = min(left, count)
            if count > used:
                by_room[room].append((pack, count - used))
            if not by_room[room]:
                del by_room[room]
            by_room.setdefault(room - length, []).append(([*pack, length], used))
            left -= used
    return [p for room in sorted(by_room) for p in by_room[room]]


def slot_rows(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, pieces a pack, first sequence, offset).

    The pieces of one length take the packs in order, as many for each pack as
    its pattern holds.
    """
    rows, rank, sequence = [], {}, 0
    for pack, count in patterns:
        at = 0
        while at < len(pack):
            many = pack.count(pack[at])  # equal lengths stand together
            first = rank.get(pack[at], 0)
            rank[pack[at]] = first + many * count
            rows.append((pack[at], first, first + many * count, many, sequence, sum(pack[:at])))
            at += many
        sequence += count
    return rows


def pack(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, end_id: int = 1) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of its whole text, then `end_id`; a null text is
    empty, so every row has at least one piece.  Pieces are cut at multiples
    of `length`.  sequence_id counts from 0; the pieces of a sequence lie at
    gapless offsets from 0.  Repeated rows are packed as often as they come, a
    null id is packed like any other.  An empty table gives an empty result.
    A text of any length is tokenised whole, in parts that end at white space.
    Other columns are not returned, whatever their names.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    text_batches(docs.sparkSession)
    run = _pieces(Path(tokenizer_file).read_text(), length, end_id)
    pieces = materialize(docs.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"), "pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `length` rows
    slots = slot_rows(shortest_pack_first(histogram, length))
    spark = docs.sparkSession
    names = "length long, lo long, hi long, many long, first long, base long"
    slots = spark.createDataFrame(slots, names)
    # a length's rows are ranked in parts of RANKED rows, or an even share of all rows where that is less
    share = min(RANKED, max(1, sum(histogram.values()) // int(spark.conf.get("spark.sql.shuffle.partitions"))))
    shares = spark.createDataFrame([(n, -(-c // share)) for n, c in histogram.items()], "length long, parts long")

    pieces = pieces.join(F.broadcast(shares), "length")
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("parts"))).drop("parts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    own = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("own", F.row_number().over(own) - 1).join(counts, ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("ahead") + F.col("own"))
    # slots: a few for each length, so their number is bounded by the length
    met = ranked.join(F.broadcast(slots), (ranked["length"] == slots["length"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).drop(slots["length"])
    nth = F.col("rank") - F.col("lo")
    return met.select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("first") + F.floor(nth / F.col("many"))).cast("long").alias("sequence_id"),
        (F.col("base") + nth % F.col("many") * F.col("length")).cast("long").alias("offset"),
    )
