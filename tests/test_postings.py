import random

import pytest

from sedge.functions.profiles import LATIN
from sedge.operators import lexical


def by_hand(rows, size):
    out = {}
    for term in {r[0] for r in rows}:
        entries = sorted((i, tf) for t, i, tf in rows if t == term)
        out |= {(term, at // size): entries[at : at + size] for at in range(0, len(entries), size)}
    return out


@pytest.mark.parametrize("size", (1, 7, 64))
def test_segments_of_terms_in_one_part_and_in_several(spark, size):
    rnd = random.Random(size)
    rows = [("hot", i, rnd.randrange(1, 9)) for i in range(3000)] + [(f"t{k}", i, 1) for k in range(150) for i in rnd.sample(range(-500, 500), rnd.randrange(1, 40))]
    df = spark.createDataFrame(rnd.sample(rows, len(rows)), "term string, id long, tf long").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = lexical.posting_segments(df, size)
        found = got.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.term, r.segment): [tuple(x) for x in r.list] for r in found} == by_hand(rows, size) and len(found) == len(by_hand(rows, size))
    assert all(r.n == len(r.list) for r in found)
    # only pieces of terms in several parts are shuffled again: before, all postings were, twice
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2
    assert lexical.posting_segments(df.where("1 = 0"), size).count() == 0


def test_postings_of_rows_that_share_an_id_are_added_up(spark):
    rows = [(1, "walk walks b1 b1"), (2, None), (3, "the a ."), (4, "walks"), (None, "lost")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    post = lambda x: sorted(map(tuple, lexical.posting_rows(x, LATIN, "doc_id").collect()))
    assert post(df) == [("b1", 1, 2), ("walk", 1, 1), ("walks", 1, 1), ("walks", 4, 1)]
    assert post(df.union(df)) == [("b1", 1, 4), ("walk", 1, 2), ("walks", 1, 2), ("walks", 4, 2)]
