import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from sedge.llm import language_id
from sedge.llm.language_id import Model, calibrate, fit, grams, identify_languages, softmax, weigh

SYLLABLES = {"en": "th ing on the er an re".split(), "de": "sch ein ung ü der ch".split(), "fr": "eau é que les oi ment".split()}


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        text = " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 60)))
        rows.append((i, text, lang if rng.random() < 0.9 else None, lang))
    return rows


def test_held_out_accuracy_and_edges(spark):
    rows = corpus()
    odd = [(9001, None, "en"), (9002, "12 % !", "de"), (9003, "", None), (None, "schein ung der", "de"), (9004, "THE ING THON", None), (9004, "THE ING THON", None)]
    df = spark.createDataFrame([r[:3] for r in rows] + odd, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("clash"))
    got = identify_languages(df).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {r[0]: r[3] for r in rows}
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert len(held) > 50 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.lang_score <= 1
    said = {r.doc_id: (r.lang_pred, r.lang_score) for r in got}
    assert said[9001] == said[9002] == said[9003] == ("und", 0.0)
    assert said[None][0] == "de" and said[9004][0] == "en"


def test_nothing_learned(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[-2:] for r in identify_languages(df).collect()] == [("und", 0.0)]
    assert identify_languages(df.where("1 = 0")).count() == 0


def test_ftrl_is_sparse_and_temperature_calibrates():
    rng = random.Random(2)
    rows = [(t, l) for _, t, l, _ in corpus(200, 3) if l]
    idf = np.ones(1 << 14)
    langs = sorted(SYLLABLES)
    data = [(at, weigh(at, tf, idf), langs.index(l)) for t, l in rows for at, tf in [grams(t)]]
    w = fit(data, 3)
    assert (w != 0).mean() < 0.2 and (w != 0).any()
    logits = np.array([[2.0, 0.0]] * 100)
    truth = np.array([0] * 75 + [1] * 25)
    t = calibrate(logits, truth)
    assert abs(softmax(logits[:1] / t)[0, 0] - 0.75) < 0.01
    rng.shuffle(rows)
    assert Model(langs, idf, w, 1.0).predict("sch ein ung")[0] == "de"


def test_training_task_gets_bounded_rows(spark, monkeypatch):
    train = language_id._train

    def bounded(idf, limit):
        inner = train(idf, limit)

        def run(pdf):
            assert pdf.groupby("lang").size().max() <= limit
            return inner(pdf)

        return run

    monkeypatch.setattr(language_id, "_train", bounded)
    df = spark.createDataFrame([r[:3] for r in corpus(6000)], "doc_id long, text string, lang string")
    assert identify_languages(df, train_rows=4).count() == 6000


def plain_ftrl(rows, n_langs):
    """The update of each weight by itself, in plain numbers."""
    import math

    from sedge.llm.language_id import ALPHA, BETA, EPOCHS, L1, L2

    z, n = {}, {}

    def weight(f, c):
        v = z.get((f, c), 0.0)
        if abs(v) <= L1:
            return 0.0
        return -(v - math.copysign(L1, v)) / ((BETA + math.sqrt(n.get((f, c), 0.0))) / ALPHA + L2)

    for _ in range(EPOCHS):
        for at, x, lang in rows:
            w = {(f, c): weight(f, c) for f in at for c in range(n_langs)}
            logits = [sum(v * w[f, c] for f, v in zip(at, x)) for c in range(n_langs)]
            top = max(logits)
            e = [math.exp(v - top) for v in logits]
            for f, v in zip(at, x):
                for c in range(n_langs):
                    g = v * (e[c] / sum(e) - (c == lang))
                    old = n.get((f, c), 0.0)
                    z[f, c] = z.get((f, c), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / ALPHA * w[f, c]
                    n[f, c] = old + g * g
    return {k: weight(*k) for k in z}


def test_ftrl_equals_a_plain_loop():
    langs = sorted(SYLLABLES)
    data = [(at, weigh(at, tf, np.ones(1 << 14)), langs.index(l)) for _, t, l, _ in corpus(40, 4) if l for at, tf in [grams(t)]]
    got, want = fit(data, 3), plain_ftrl([(at.tolist(), x.tolist(), y) for at, x, y in data], 3)
    assert all(abs(got[f, c] - v) < 1e-9 for (f, c), v in want.items())
    assert np.count_nonzero(got) == sum(v != 0 for v in want.values())


def test_very_long_texts_and_rates(spark):
    rows = [r[:3] for r in corpus(300)] + [(5000, "sch ein ung der " * 60_000, None), (5001, "th ing on the " * 60_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in identify_languages(df).collect()}
    assert got[5000] == "de" and got[5001] == "en"
