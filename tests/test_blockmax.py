import math
import random

import numpy as np
from pyspark.sql import functions as F

from sedge.functions.profiles import RUSSIAN
from sedge.operators import blockmax, lexical
from sedge.operators.blockmax import PostingList, best


def listed(entries, avgdl):
    return PostingList(**PostingList.encode(*(np.array(c, np.int64) for c in zip(*entries)), avgdl))


def test_lists_keep_their_entries():
    rnd = random.Random(1)
    ids = np.array(sorted(rnd.sample(range(-(10**6), 10**12), 1000)), np.int64)
    tf, dl = (np.array([rnd.choice([1, 2, 300, 70_000]) for _ in ids], np.int64) for _ in range(2))
    p = PostingList(**PostingList.encode(ids, tf, dl, 10.0))
    blocks = [p.block(i) for i in range(len(p.first))]
    assert [np.concatenate(c).tolist() for c in zip(*blocks)] == [ids.tolist(), tf.tolist(), dl.tolist()]
    assert all((blockmax.weight(b[1], b[2], 10.0) <= m).all() for b, m in zip(blocks, p.most))


def plain(lists, terms, k, avgdl):
    total = {}
    for term, idf in terms:
        for i, tf, dl in lists.get(term, ()):
            total[i] = total.get(i, 0.0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))
    return sorted(((i, math.floor(s * 1e6 + 0.5) / 1e6) for i, s in total.items()), key=lambda x: (-x[1], x[0]))[:k]


def test_search_is_exact_and_skips_blocks():
    rnd = random.Random(2)
    decoded, blocks = [0, 0], [0, 0]  # of queries of one term, of several
    for trial in range(60):
        n = 6000
        dl = [rnd.randrange(5, 60) for _ in range(n)]
        lists = {t: [(i, rnd.choice([1] * 20 + [2, 3]), dl[i]) for i in sorted(rnd.sample(range(n), size))] for t, size in (("the", 5000), ("of", 2500), ("rare", 30), ("other", 400))}
        for t, entries in lists.items():  # some rows of each list stand out
            out = set(rnd.sample([e[0] for e in entries], 12))
            lists[t] = [(j, 40, dl[j]) if j in out else (j, tf, d) for j, tf, d in entries]
        held = {t: listed(e, 30.0) for t, e in lists.items()}
        terms = [(t, math.log(1 + n / len(lists[t]))) for t in rnd.sample(sorted(lists), rnd.randrange(1, 4))] + [("absent", 9.0)]
        assert best(held, terms, 10, 30.0) == plain(lists, terms, 10, 30.0)
        decoded[len(terms) > 2] += sum(len(p.decoded) for p in held.values())
        blocks[len(terms) > 2] += sum(len(held[t].first) for t, _ in terms if t in held)
    assert decoded[0] < 0.6 * blocks[0] and decoded[1] < 0.9 * blocks[1], (decoded, blocks)


def test_top_equals_bm25_over_shards(spark):
    rnd = random.Random(3)
    words = [f"слово{i}" for i in range(30)]
    rows = [(i, " ".join(rnd.choices(words, weights=[60 - 2 * j for j in range(30)], k=rnd.randrange(0, 25)))) for i in range(900)]
    df = spark.createDataFrame(rows, "id int, text string")
    counted = lexical.counted(lexical.occurrences(df, RUSSIAN))
    sizes = lexical.lengths(counted)
    stats = lexical.statistics(sizes)
    asked = spark.createDataFrame([(q, " ".join(rnd.sample(words, 3))) for q in range(25)] + [(99, "нет")], "query_id int, text string")
    terms = lexical.query_terms(asked, RUSSIAN)
    want = lexical.top_per_query(lexical.bm25(terms, lexical.postings(counted), sizes, stats).withColumn("score", F.round("score", 6)), 8)
    want = {(r.query_id, r.id, r["rank"]): r.score for r in want.collect()}
    for shard in (100, 10**6):
        lists, shards, n, avgdl = blockmax.shard_lists(lexical.postings(counted), sizes, stats, shard)
        got = blockmax.top(terms, lists, shards, n, avgdl, 8)
        assert {(r.query_id, r.id, r["rank"]): round(r.score, 6) for r in got.collect()} == want
    assert got.schema["query_id"].dataType.simpleString() == "int" and shards == 1
    none = blockmax.shard_lists(lexical.postings(counted).where("1 = 0"), sizes, lexical.statistics(sizes.where("1 = 0")))
    assert n == 900 and blockmax.top(terms, *none, 8).count() == 0
