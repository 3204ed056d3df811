import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from sedge.llm.conversation_trie import TernaryTree, median_order, prefix_trie, rebuilt
from sedge.llm.sql_records import OP12

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """Every prefix of every rebuilt conversation."""
    own = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own.setdefault(conv_id, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    members, ends = {}, {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        turns = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    out = {}
    below = {node: [v for v in members if v[: len(node)] == node] for node in members}
    for node, convs in members.items():
        kids = [v for v in below[node] if len(v) == len(node) + 1]
        saved = sum((len(members[v]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", v[-1][1])) for v in below[node] if v)
        leaves = sum(not any(len(w) == len(v) + 1 for w in below[v]) for v in below[node])
        ids = ",".join(map(str, sorted(ends.get(node, []))))
        out[min(convs), len(node)] = (min(members[node[:-1]]) if node else None, len(convs), len(kids), leaves, saved, hashlib.sha256(ids.encode()).hexdigest())
    return out


def random_rows(seed, n):
    rnd = random.Random(seed)
    turn = lambda: (rnd.choice(["user", "assistant", None]), rnd.choice(["a b", "c", None, " d\n e f", "long " * 200]))
    stock = [[turn() for _ in range(rnd.choice([1, 3, 6, 14]))] for _ in range(8)]
    rows = []
    for c in [None, *rnd.sample(range(-60, 400), n)]:
        first = rnd.choice(stock)
        turns = first[: rnd.randrange(len(first) + 1)] + [turn() for _ in range(rnd.choice([0, 0, 1, 5]))] or [turn()]
        rows += [(c, None if rnd.random() < 0.02 else i * 3, *t) for i, t in enumerate(turns)]
    rnd.shuffle(rows)
    return rows + rows[:4]


def got(df):
    rows = df.collect()
    out = {(r.conv_id, r.depth): tuple(r)[2:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_ternary_tree():
    rnd = random.Random(2)
    words = sorted({tuple(rnd.choices(range(5), k=rnd.randrange(1, 6))) for _ in range(300)})
    tree, paths = TernaryTree(), {}
    assert sorted(median_order(len(words))) == list(range(len(words)))
    for i in median_order(len(words)):
        paths[words[i]] = tree.insert(list(words[i]))
    prefixes = {w[:d] for w in words for d in range(1, len(w) + 1)}
    assert len(tree.symbol) == len(prefixes) == len({n for p in paths.values() for n in p})
    order = tree.top_down()
    seen = {node: i for i, node in enumerate(order)}
    assert sorted(order) == list(range(len(prefixes))) and all(tree.above[n] < 0 or seen[tree.above[n]] < seen[n] for n in order)
    # medians first: a sorted run of 1,023 symbols is searched in at most 10 steps
    tree = TernaryTree()
    for i in median_order(1023):
        tree.insert([i])
    depth = {tree.root: 1}
    for n in tree.top_down():
        depth |= {link: depth[n] + 1 for link in (tree.less[n], tree.more[n]) if link >= 0}
    assert max(depth.values()) <= 11


@pytest.mark.parametrize("piece,shard,top", [(256, 200_000, 2000), (256, 40, 24), (3, 30, 32)])
def test_nodes_equal_brute_force(spark, piece, shard, top):
    rows = random_rows(7, 90)
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", place string").repartition(5)
    assert got(prefix_trie(*rebuilt(df), piece, shard, top)) == plain(rows)


def test_long_and_equal_conversations(spark):
    """Two equal long conversations, one that leaves them late, one alone: few pieces are searched, no row is lost."""
    long_ = [("user", f"w{i} x") for i in range(40)]
    rows = [(c, i, *t) for c in (20, 40, 61) for i, t in enumerate(long_)] + [(80, i, *t) for i, t in enumerate(long_[:25] + [("user", "other")] * 9)]
    rows += [(100, i, "assistant", f"alone {i}") for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(prefix_trie(*rebuilt(df), 8, 50, 6)) == plain(rows)


def test_sql_says_the_same():
    rows = random_rows(8, 60)
    db = duckdb.connect()
    db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert {r[:2]: r[2:] for r in db.execute(OP12).fetchall()} == plain(rows)


def test_empty_and_turnless(spark):
    assert prefix_trie(*rebuilt(spark.createDataFrame([], SCHEMA))).count() == 0
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 > 1)  # its base is absent, its only turn is replaced
    rows = [(c, 0, "user", "gone"), (None, 0, "user", "no id")]
    none = hashlib.sha256(str(c).encode()).hexdigest()
    assert got(prefix_trie(*rebuilt(spark.createDataFrame(rows, SCHEMA)))) == {(c, 0): (None, 1, 0, 1, 0, none)}


def test_places_within_a_conversation_of_many_tasks(spark):
    from sedge.llm.conversation_trie import placed_turns

    df = spark.range(3000).select((F.col("id") % 2 * 7).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        places = placed_turns(df.repartition(3)).groupBy("conv_id").agg(F.count_distinct("place").alias("n"), F.max("place").alias("top")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r.conv_id, r.n, r.top) for r in places} == {(0, 1500, 1499), (7, 1500, 1499)}
