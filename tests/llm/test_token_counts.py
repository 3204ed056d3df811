import random

import public_tokenizers

from sedge.llm.token_counts import LongestMatch, sentence_pieces, token_counts


def brute(word, pieces, prefix):
    text, at, n = prefix + word, 0, 0
    while at < len(text):
        end = next((e for e in range(len(text), at, -1) if text[at:e] in pieces), None)
        n += 1 if end else len(text[at].encode())
        at = end or at + 1
    return n


def test_random_vocabularies():
    rng = random.Random(3)
    for _ in range(300):
        pieces = {"".join(rng.choice("abcé") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(0, 12))} | ({"_a"} if rng.random() < 0.5 else set())
        match = LongestMatch(sorted(pieces), "_")
        for _ in range(20):
            word = "".join(rng.choice("abcéz") for _ in range(rng.randrange(0, 12)))
            assert match.count(word) == brute(word, pieces, "_"), (pieces, word)


def test_documents(spark):
    pieces = sentence_pieces(str(public_tokenizers.path("piece_bpe_32k.model")))
    texts = ["The quick brown fox\n  jumps", None, "", " \t", "日本語 naïve 😀", "w" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0]), (None, "a b")], "doc_id long, text string")
    known = set(pieces)
    want = [(i, len((t or "").split()), sum(brute(w, known, "▁") for w in (t or "").split())) for i, t in [*enumerate(texts), (0, texts[0]), (None, "a b")]]
    assert sorted((tuple(r) for r in token_counts(df, pieces).collect()), key=str) == sorted(want, key=str)
    assert token_counts(df.where("1 = 0"), pieces).count() == 0
