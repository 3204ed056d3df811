import re

import pyarrow as pa

from sedge.llm.words import segments, slices, word_table


def test_words_and_hashes():
    morse = "a"
    for _ in range(10):  # polynomials modulo powers of two give these two words one hash
        morse += morse.translate(str.maketrans("ab", "ba"))
    texts = [morse + " " + morse.translate(str.maketrans("ab", "ba")), "", "a\x0bb  ab\x1cc d ", "AbcdefghI abcdefghi", "x" * 300 + " " + "x" * 301 + " " + "x" * 300]
    w = word_table(pa.array(texts))
    words = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    assert [b - a for a, b in zip(w.ptr, w.ptr[1:])] == [len(x) for x in words]
    flat = [x for ws in words for x in ws]
    for lane in (w.hash, w.hash2):
        assert len(set(lane.tolist())) == len(set(flat)) and len({(x, h) for x, h in zip(flat, lane.tolist())}) == len(set(flat))
    low = word_table(pa.array(texts), lower=True)
    at = flat.index("AbcdefghI")
    assert low.hash[at] == low.hash[at + 1] == w.hash[at + 1]


def test_slices_and_segments_keep_everything():
    column = pa.array(["ab " * n for n in range(50)])
    assert sum(n for _, n in slices(column, 40)) == 50
    text = ("word\tand  " * 300 + "y" * 500).encode()
    parts = list(segments(text, 64))
    assert b"".join(parts) == text and [w for p in parts for w in p.split()] == text.split()
