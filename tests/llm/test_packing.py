import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sedge.llm import packing
from sedge.llm.packing import pack, shortest_pack_first, slot_rows

FILE = str(public_tokenizers.path("word_bpe_49k.json"))


def test_patterns_place_every_piece_once():
    rng = random.Random(2)
    for limit in (16, 64):
        for _ in range(40):
            histogram = {rng.randrange(1, limit + 1): rng.randrange(1, 50) for _ in range(rng.randrange(1, 20))}
            patterns = shortest_pack_first(histogram, limit)
            got = defaultdict(int)
            for p, n in patterns:
                assert sum(p) <= limit and n > 0 and p == sorted(p, reverse=True)
                for x in p:
                    got[x] += n
            assert got == histogram
            ends = defaultdict(int)
            for length, lo, hi, many, _, _ in slot_rows(patterns):
                assert lo == ends[length] and (hi - lo) % many == 0
                ends[length] = hi
            assert ends == histogram
    assert shortest_pack_first({}, 8) == []
    assert sorted(shortest_pack_first({5: 2, 3: 3, 1: 1}, 8)) == sorted([([5, 3], 2), ([3, 1], 1)])


def test_sequences_hold_all_ids(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 7)
    rng = random.Random(4)
    words = ["The", "tion", "über", "été,", "x#%", "don't", "日本", "42nd", "naïve-ish", "a\u00a0b", "<|endoftext|>", "ΣΑΣ"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))) for _ in range(120)]
    texts += [None, "", "  ", " ".join(words * 40), "same same"] + ["same same"] * 30
    rows = list(enumerate(texts)) + [(3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("clash"))
    got = pack(df, FILE, length=64).collect()
    tokenizer = Tokenizer.from_file(FILE)
    want = []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 64):
            piece = np.array(ids[at : at + 64], dtype="<u4")
            want.append((i, at, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == sorted(want)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(sequences) == set(range(len(sequences)))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= 1.1 * sum(r.length for r in got) / 64 + 1
    assert pack(df.where("1 = 0"), FILE).count() == 0


def test_words_have_the_ids_of_the_tokenizer():
    tokenizer = Tokenizer.from_file(FILE)
    signs = [chr(c) for c in range(0x21, 0x260)]
    words = [a + b for a in ["", *"sZ9.É'<"] for b in signs] + [b + a for a in "dZ9.É'>" for b in signs]
    words = list(dict.fromkeys(w for w in words + ["l'été's", "a''s", "éx", "İ", "ǅ"] if w.split() == [w]))
    size, ids = packing._Ids(tokenizer).of(words)
    want = [tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    assert size.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_very_long_texts_and_odd_rows(spark, monkeypatch):
    from sedge.llm import word_cache

    monkeypatch.setattr(word_cache, "TEXT_BYTES", 256)  # in this process only: the kernel is run here
    long = "Ünder the stone, 1984 don't " * 4000
    text = pa.array([long, "", "x" * 3000, " \n "])
    encode = packing.encoder(open(FILE).read())
    for row in text:
        sizes, ids = encode.runs(pa.array([row.as_py()]))
        want = Tokenizer.from_file(FILE).encode(row.as_py(), add_special_tokens=False).ids
        assert sizes.tolist() == [len(want)] and ids.tolist() == want
    rows = [(1, long), (None, "null id"), (2, None), (2, None)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string"), FILE)
    totals = {(r.doc_id, r.doc_tokens) for r in got.collect()}
    assert len(totals) == 3 and (2, 1) in totals and max(n for _, n in totals) > 30_000
