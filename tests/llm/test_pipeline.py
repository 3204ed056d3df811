import random
from collections import defaultdict

import corpus_pipeline
from tests.llm.test_language_id import SYLLABLES
from tests.llm.test_near_dedup import shingles


def corpus():
    rng = random.Random(6)

    def text(lang, n):
        return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(2, 6))) for _ in range(n))

    rows = []
    for i in range(160):
        lang = rng.choice(list(SYLLABLES))
        rows.append([i, text(lang, rng.randrange(20, 150)), lang, f"src{i % 7}"])
    rows[5][1] = text("en", 150)
    passage = text("en", 80)
    rows[10][1] += " " + passage
    rows[90][1] += " " + passage
    copy = rows[5][1].split()
    copy[3] = "zzz"
    rows.append([300, " ".join(copy), "en", "src1"])
    rows.append([301, rows[6][1], "en", None])
    rows += [[302, "1234 !!", "en", "src2"], [303, None, None, "src3"], [304, rows[8][1], None, "src0"], [rows[20][0], rows[20][1], rows[20][2], rows[20][3]]]
    return [(i, t, l, s, len(t) if t is not None else None) for i, t, l, s in rows], passage


def test_stages_take_effect(spark):
    rows, passage = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        docs = corpus_pipeline.materialize(docs, name)
        out[name] = docs.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id for r in out["language_id"]} == {r[0] for r in rows} - {302, 303}
    assert all(r.lang for r in out["language_id"])
    near = out["near_dedup"]
    assert {r.doc_id for r in near} == {r.doc_id for r in out["language_id"]} - {300, 301, 304} and len({r.doc_id for r in near}) == len(near)
    sets = [shingles(r.text, 5) for r in near]
    assert all(5 * len(a & b) < 4 * len(a | b) for i, a in enumerate(sets) for b in sets[i + 1 :] if a and b)
    cut = {r.doc_id: r.text for r in out["substring_dedup"]}
    assert passage in cut[10] and passage not in cut[90] and cut[90] and len(cut) == len(near)
    assert all(cut[r.doc_id] == r.text for r in near if r.doc_id != 90)
    total, kept = (sum(len(r.text.split()) for r in out[s]) for s in ("substring_dedup", "mixing"))
    assert 0.6 * total <= kept <= 0.8 * total and {r.doc_id for r in out["mixing"]} <= set(cut)
    pieces = defaultdict(int)
    for r in out["packing"]:
        pieces[r.doc_id] += r.length
        assert r.length <= 2048
    assert set(pieces) == {r.doc_id for r in out["mixing"]}


def test_odd_tables(spark):
    """Clashing columns, nulls, repeated rows and empty tables go through every stage."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, held_out string, mix_tokens int, rk int, spans string, count int"
    one = (None, "sch ein ung der", None, None, None, "h", 1, 2, "s", 3)
    rows = [one, one, (4, None, None, "x", 0, "h", 1, 2, "s", 3), (5, "ung der sch", "de", "src1", 3, "h", 1, 2, "s", 3), (5, "ung der sch", "de", "src1", 3, "h", 1, 2, "s", 3)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        names = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.materialize(stage(spark, docs, ""), name)
            assert docs.columns == names
            assert all(r.held_out == "h" and r["count"] == 3 and r.spans == "s" for r in docs.collect())
        assert docs.where("doc_id = 5").count() <= 1
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()


def test_stages_equal_a_plain_pipeline(spark):
    """What every stage decides, computed again from the rows that the stage before it kept."""
    import hashlib
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    from sedge.llm import mixing
    from sedge.llm.language_id import identify_languages
    from sedge.llm.mixing import DOCUMENTS_WEIGHTS
    from sedge.llm.queries import vocabulary
    from tests.llm.test_mixing import fill
    from tests.llm.test_near_dedup import brute as near_brute
    from tests.llm.test_substring_dedup import brute as cut_brute

    rows, _ = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([r for i, r in enumerate(rows) if i != len(rows) - 1], schema)  # without the repeated row
    said = {r.doc_id: (r.lang_pred, r.lang_score) for r in identify_languages(docs).collect()}
    before, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        before = corpus_pipeline.materialize(stage(spark, before, ""), name)
        kept[name] = before.collect()
    want = {r[0] for r in rows if said[r[0]][0] != "und" and said[r[0]][1] >= corpus_pipeline.MIN_SCORE}
    assert {r.doc_id for r in kept["language_id"]} == want
    plain = [(r.doc_id, r.text) for r in kept["language_id"]]
    assert {r.doc_id for r in kept["near_dedup"]} == {i for i, (_, c) in near_brute(plain, 5, 4, 5).items() if i == c}
    plain = sorted((r.doc_id, r.text) for r in kept["near_dedup"])
    assert {r.doc_id: " ".join(r.text.split()) for r in kept["substring_dedup"]} == {i: t for i, _, _, t in cut_brute(plain, 50)}

    tree = lambda r: (f"domain{int(r.source[3:]) % 4}" if r.source else "domain-", r.lang, r.source or "")
    leaves, tokens = defaultdict(list), lambda r: len(r.text.split())
    for r in kept["substring_dedup"]:
        leaves[tree(r)].append(r)
    cap = {k: sum(map(tokens, v)) for k, v in leaves.items()}
    budget = {(): sum(cap.values()) * 8 // 10}
    for depth, level in enumerate(("domain", "lang", "source")):
        for parent in {k[:depth] for k in cap}:
            caps = defaultdict(int)
            for k, n in cap.items():
                if k[:depth] == parent:
                    caps[k[depth]] += n
            shares = fill(dict(caps), {c: DOCUMENTS_WEIGHTS.get(level, {}).get(c, 1) for c in caps}, budget[parent])
            budget |= {(*parent, c): n for c, n in shares.items()}
    mixed = set()
    for leaf, own in leaves.items():
        epochs, left = divmod(budget[leaf], cap[leaf]) if cap[leaf] else (0, 0)
        for r in sorted(own, key=lambda r: hashlib.md5(f"17:{epochs}:{r.doc_id}".encode()).hexdigest()):
            left -= tokens(r)
            if epochs or left >= 0:
                mixed.add(r.doc_id)
            else:
                left = -1
    assert {r.doc_id for r in kept["mixing"]} == mixed and mixing.BUCKET_ROWS

    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    pieces = set()
    for r in kept["mixing"]:
        ids = np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 1], "<u4")
        pieces |= {(r.doc_id, at, zlib.crc32(ids[at : at + 2048].tobytes())) for at in range(0, len(ids), 2048)}
    assert {(r.doc_id, r.start, r.ids_crc32) for r in kept["packing"]} == pieces


def test_very_long_texts(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice(SYLLABLES["en"]) for _ in range(3)) + str(i) for i in range(30_000)]
    short = [(i, " ".join("".join(rng.choice(SYLLABLES[x]) for _ in range(3)) for _ in range(30)), x, "src1", 1) for i, x in enumerate(list(SYLLABLES) * 20)]
    rows = [*short, (900, " ".join(words), "en", "src1", 1), (901, " ".join(words[15_000:] + words[:3000][::-1]), "en", "src1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = corpus_pipeline.materialize(stage(spark, docs, ""), name)
    got = {r.doc_id: len(r.text.split()) for r in docs.where("doc_id >= 900").collect()}
    assert got == {900: 30_000, 901: 3000}
