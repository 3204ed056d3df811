import hashlib
import random
import re
import zlib

import duckdb
import pytest

from sedge.llm import conversation_repair
from sedge.llm.conversation_repair import cheapest_edits, damaged, repair_conversations, repaired_turns
from sedge.llm.sql_records import OP13

SCHEMA = "conv_id long, turn long, role string, text string"
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def plain_edits(turns, start=0, finals=(0, 3)):
    """All states, turn by turn, with every insert tried."""
    ways = {start: (0, "")}

    def inserted(ways):
        for _ in range(3):
            for q, (cost, audit) in list(ways.items()):
                for role, after in NEXT[q].items():
                    if role != "s":
                        ways[after] = min(ways.get(after, (10**9, "")), (cost + 5, audit + "I"))
        return ways

    for initial, fault in turns:
        new = {}
        for q, (cost, audit) in inserted(ways).items():
            options = [(q, 2, "D")]
            if fault not in (1, 2):
                options += [(NEXT[q][initial], 0 if fault == 0 else 5, "K")] if initial in NEXT[q] else []
                options += [(after, 1 if fault == 0 else 6, "R") for role, after in NEXT[q].items() if role != "s"]
            for after, price, edit in options:
                new[after] = min(new.get(after, (10**9, "")), (cost + price, audit + edit))
        ways = new
    return min((w for q, w in inserted(ways).items() if q in finals), default=None)


def plain_report(rows):
    """The contract, a conversation at a time."""
    out = {}
    for conv_id in {r[0] for r in rows}:
        turns = []
        for _, turn, role, text in (r for r in rows if r[0] == conv_id):
            role, text = " " if role is None else role, " " if text is None else text
            key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
            lot = zlib.crc32(key.encode()) % 20
            text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
            turns += [(turn, "user" if lot == 4 else role, text)] * (0 if lot == 0 else 2 if lot == 3 else 1)
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        faults, seen = [], set()
        for _, role, text in turns:
            body = text.strip(" \t\n\v\f\r")
            faults.append(1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0)
            seen.add((role, text))
        initials = [t[1][:1] for t in turns]
        cost, audit = plain_edits(list(zip(initials, faults)))
        repaired, state, at = [], 0, 0
        for edit in audit:
            forced = {0: "u", 1: "u", 2: "a", 3: "u"}[state]
            if edit == "I":
                repaired.append(({"u": "user", "a": "assistant"}[forced], ""))
                state = NEXT[state][forced]
                continue
            _, role, text = turns[at]
            at += 1
            if edit == "K":
                repaired.append((role, text))
                state = NEXT[state][role[:1]]
            elif edit == "R":
                repaired.append(({"u": "user", "a": "assistant"}[forced], text))
                state = NEXT[state][forced]
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0][0] for r in repaired))
        known = [t[0] for t in turns if t[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out[conv_id] = (gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, audit, digest), repaired
    return out


def random_rows(seed, n):
    rnd = random.Random(seed)
    text = lambda: rnd.choice([None, "", " \n", "a.", "a.", "b?", "ends", "c! \t", "x" * 3000 + ".", "Ünd."])
    rows = []
    for conv_id in [None, *range(n)]:
        for _ in range(rnd.choice([1, 1, 2, 4, 7, 30])):
            rows.append((conv_id, rnd.choice([None, *range(12)]), rnd.choice(["system", "user", "user", "assistant", "assistant", "tool", None]), text()))
    return rows + rows[:5]


def test_search_finds_the_least_audit_of_the_cheapest():
    rnd = random.Random(5)
    for _ in range(3000):
        turns = [(rnd.choice("suuaat "), rnd.choice([0, 0, 0, 1, 2, 3])) for _ in range(rnd.randrange(9))]
        start, finals = rnd.randrange(4), rnd.choice([(0, 3), (0,), (1,), (2,), (3,)])
        assert cheapest_edits(turns, start, finals) == plain_edits(turns, start, finals), (turns, start, finals)


@pytest.mark.parametrize("segment", [3, 512])
def test_reports_equal_the_contract(spark, segment):
    rows = random_rows(11, 60)
    df = damaged(spark.createDataFrame(rows, SCHEMA).repartition(3))
    want = plain_report(rows)
    got = {r.conv_id: tuple(r)[1:] for r in repair_conversations(df, segment).collect()}
    assert got == {k: v[0] for k, v in want.items()}
    turns = {}
    for r in repaired_turns(df, segment).orderBy("place").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    assert turns == {k: v[1] for k, v in want.items() if v[1]}


def test_sql_says_the_same():
    rows = random_rows(12, 40)
    db = duckdb.connect()
    db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert {r[0]: r[1:] for r in db.execute(OP13).fetchall()} == {k: v[0] for k, v in plain_report(rows).items()}


def test_one_conversation_of_many_turns(spark, monkeypatch):
    """All rows are one conversation: it is solved in segments of many tasks, and repeated turns are counted once."""
    rows = [(7, i, ("user", "assistant")[i % 2], f"turn {i % 900}" + ("." if i % 11 else "")) for i in range(2000)] + [(7, 2500, "user", "again.")] * 300
    want = plain_report(rows)[7][0]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = repair_conversations(damaged(spark.createDataFrame(rows, SCHEMA)), 64).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [tuple(r) for r in got] == [(7, *want)]
    monkeypatch.setattr(conversation_repair, "SEGMENT_BYTES", 10)  # segments by bytes of text
    assert [tuple(r) for r in repair_conversations(damaged(spark.createDataFrame(rows[:50], SCHEMA))).collect()] == [(7, *plain_report(rows[:50])[7][0])]


def test_empty_and_undamaged(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair_conversations(damaged(none)).count() == 0 and repaired_turns(none).count() == 0
    rows = [(1, 0, "system", "s."), (1, 1, "user", "u."), (1, 2, "assistant", "a."), (2, 5, "assistant", None)]
    extra = spark.createDataFrame([(*r, "clash", 1.5) for r in rows], SCHEMA + ", audit string, pid double")
    got = {r.conv_id: r for r in repair_conversations(extra).collect()}
    assert (got[1].cost, got[1].audit) == (0, "KKK") and (got[2].cost, got[2].audit, got[2].blank) == (2, "D", 1)
