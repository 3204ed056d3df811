"""Conversation structure repair: cheapest edits to a legal order of roles.

A conversation is legal if the initials of its roles read `(s?(ua)+)?`.  The
edits of its turns form a lattice: a node is (turns consumed, state of the
grammar), an edge keeps, deletes or reroles the next turn or inserts one.  A
bidirectional Dijkstra search finds the cheapest way through it, and of the
cheapest the one with the least audit (the initials of the edits).

Turns are dealt by range of (conversation, turn), so a task reads whole
conversations in order, one row at a time.  Conversations that reach over the
end of a partition, and those of more than SEGMENT turns, are cut into
segments; a segment is solved once for each pair of states that it may begin
and end in, and the segments of a conversation are then folded in order.  So a
conversation that holds a large part of all rows is solved in many tasks, and
none holds more of it than a segment and its audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import counted, materialize, text_batches

#: Turns (and bytes of text) of a segment at most.
SEGMENT, SEGMENT_BYTES = 512, 8 << 20

KEEP, REROLE, DELETE, INSERT, UNMENDED = 0, 1, 2, 5, 5
#: States of the grammar: nothing yet, after s, after u, after a; both ends of NEXT say which role comes next.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES, FINAL = range(4), (START, ASSISTANT)
NEXT = {START: ("u", USER), SYSTEM: ("u", USER), USER: ("a", ASSISTANT), ASSISTANT: ("u", USER)}
BEFORE = {q: [p for p in STATES if NEXT[p][1] == q] for q in STATES}
ROLES = {"u": "user", "a": "assistant"}
LEGAL_PAIRS = frozenset(("su", "ua", "au"))
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)

Turn = tuple[str, int]  # initial of the role, fault


def _kept(state: int, initial: str) -> int | None:
    """The state after a turn that is kept, or None if its role can't come here."""
    if state == START and initial == "s":
        return SYSTEM
    role, after = NEXT[state]
    return after if role == initial else None


def _edits(turn: Turn | None, state: int) -> Iterator[tuple[str, int, int, int]]:
    """(initial, cost, turns consumed, state after) of the edits before or at a turn (None: after the last)."""
    role, after = NEXT[state]
    yield "I", INSERT, 0, after
    if turn is None:
        return
    initial, fault = turn
    yield "D", DELETE, 1, state
    if fault in (BLANK, DUPLICATE):
        return
    more = UNMENDED if fault == TRUNCATED else 0
    if (kept := _kept(state, initial)) is not None:
        yield "K", KEEP + more, 1, kept
    if initial != role:
        yield "R", REROLE + more, 1, after


def _edits_into(turns: list[Turn], i: int, state: int) -> Iterator[tuple[str, int, int, int]]:
    """(initial, cost, turns consumed, state before) of the edits that lead to (i, state)."""
    for before in BEFORE[state]:
        yield "I", INSERT, 0, before
    for before in STATES if i else ():
        for initial, cost, used, after in _edits(turns[i - 1], before):
            if used and after == state:
                yield initial, cost, 1, before


def cheapest_edits(turns: list[Turn], start: int = START, finals: tuple[int, ...] = FINAL) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits of `turns` from a state to one of `finals`; the least audit of equals.

    Labels are (cost, audit) of the way from the start, or to the end.  At one
    cost, nodes are settled in the order in which edges of cost 0 (which all
    consume a turn) reach them, so a label is final when its node is settled.
    No audit of a node is the beginning of another one of equal cost, so the
    least prefix and the least suffix make the least whole.  The search goes
    on until the heaps' tops add up to more than the best cost: by then every
    crossing of that cost has been seen from both sides.
    """
    n = len(turns)
    ahead: dict[tuple[int, int], tuple[int, str]] = {}
    behind: dict[tuple[int, int], tuple[int, str]] = {}
    forward, reverse = [(0, 0, "", start)], [(0, 0, "", q) for q in finals]
    best: tuple[int, str] | None = None

    def crossing(cost: int, audit: str) -> None:
        nonlocal best
        if best is None or (cost, audit) < best:
            best = cost, audit

    def settle_forward() -> None:
        cost, i, audit, state = heappop(forward)
        if (i, state) in ahead:
            return
        ahead[i, state] = cost, audit
        if (found := behind.get((i, state))) is not None:
            crossing(cost + found[0], audit + found[1])
        for initial, price, used, after in _edits(turns[i] if i < n else None, state):
            there = i + used, after
            if (found := behind.get(there)) is not None:
                crossing(cost + price + found[0], audit + initial + found[1])
            if there not in ahead:
                heappush(forward, (cost + price, i + used, audit + initial, after))

    def settle_reverse() -> None:
        cost, back, audit, state = heappop(reverse)
        i = n - back
        if (i, state) in behind:
            return
        behind[i, state] = cost, audit
        if (found := ahead.get((i, state))) is not None:
            crossing(cost + found[0], found[1] + audit)
        for initial, price, used, before in _edits_into(turns, i, state):
            there = i - used, before
            if (found := ahead.get(there)) is not None:
                crossing(cost + price + found[0], found[1] + initial + audit)
            if there not in behind:
                heappush(reverse, (cost + price, back + used, initial + audit, before))

    settle_forward()
    for _ in finals:
        settle_reverse()
    while forward and reverse and (best is None or forward[0][0] + reverse[0][0] <= best[0]):
        if forward[0][0] <= reverse[0][0]:
            settle_forward()
        else:
            settle_reverse()
    return best


def apply_edits(turns: list[tuple[str, str]], audit: str, state: int = START) -> tuple[list[tuple[str, str]], int]:
    """The repaired (role, text) of `turns` by an audit from a state on, and the state after them."""
    out, at = [], 0
    for edit in audit:
        role, after = NEXT[state]
        if edit == "I":
            out.append((ROLES[role], ""))
            state = after
            continue
        own, text = turns[at]
        at += 1
        if edit == "K":
            out.append((own, text))
            state = _kept(state, own[:1])
        elif edit == "R":
            out.append((ROLES[role], text))
            state = after
    return out, state


class _Counts:
    """Faults and illegal pairs, additive over neighbouring parts of a conversation."""

    NAMES = ("n", "blank", "duplicate", "truncated", "illegal", "distinct", "low", "high", "first", "last")

    def __init__(self) -> None:
        self.n = self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.low = self.high = self.first = self.last = None

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        self.blank += fault == BLANK
        self.duplicate += fault == DUPLICATE
        self.truncated += fault == TRUNCATED
        self.join(_single(turn, initial))

    def join(self, other: "_Counts") -> None:
        """Add the part that follows."""
        if not other.n:
            return
        if self.n:
            self.illegal += self.last + other.first not in LEGAL_PAIRS
        else:
            self.first = other.first
        self.last = other.last
        if other.low is not None:
            self.distinct += other.distinct - (self.high == other.low)
            self.low = other.low if self.low is None else self.low
            self.high = other.high
        for name in ("n", "blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + getattr(other, name))

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.distinct

    def as_dict(self) -> dict:
        return {name: getattr(self, name) for name in self.NAMES}


def _single(turn: int | None, initial: str) -> _Counts:
    one = _Counts()
    one.n, one.first, one.last = 1, initial, initial
    if turn is not None:
        one.distinct, one.low, one.high = 1, turn, turn
    return one


def _of(held: dict) -> _Counts:
    out = _Counts()
    for name in _Counts.NAMES:
        setattr(out, name, held[name])
    return out


_COUNTS = "struct<n:long,blank:long,duplicate:long,truncated:long,illegal:long,distinct:long,low:long,high:long,first:string,last:string>"
_REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_TURNS = "array<struct<role:string,text:string>>"
#: A whole conversation's report, or a segment: what each pair of states costs, and its turns.
_PASS = f"{_REPORT}, repaired {_TURNS}, pid int, seq int, counts {_COUNTS}, costs array<long>, audits array<string>, turns {_TURNS}"
_FOLD = f"{_REPORT}, states array<struct<pid:int,seq:int,before:int,after:int>>"


def _hash_of(turns: list[tuple[str, str]]) -> str:
    return hashlib.sha256("\n".join(f"{role}:{text}" for role, text in turns).encode()).hexdigest()


def _structs(turns: list[tuple[str, str]]) -> list[dict]:
    return [{"role": role, "text": text} for role, text in turns]


def _whole(conv_id: int | None, counts: _Counts, turns: list, faults: list[Turn], with_turns: bool) -> dict:
    cost, audit = cheapest_edits(faults)
    repaired, _ = apply_edits(turns, audit)
    return _report(conv_id, counts, cost, audit, _hash_of(repaired)) | ({"repaired": _structs(repaired)} if with_turns else {})


def _report(conv_id: int | None, counts: _Counts, cost: int, audit: str, digest: str | None) -> dict:
    named = {name: getattr(counts, name) for name in ("gaps", "blank", "duplicate", "truncated", "illegal")}
    return {"conv_id": conv_id, **named, "cost": cost, "audit": audit, "repaired_sha256": digest}


def _segment(conv_id: int | None, seq: int, counts: _Counts, turns: list, faults: list[Turn]) -> dict:
    ways = [cheapest_edits(faults, p, (q,)) for p in STATES for q in STATES]
    return {
        "conv_id": conv_id, "pid": TaskContext.get().partitionId(), "seq": seq, "counts": counts.as_dict(), "turns": _structs(turns),
        "costs": [None if w is None else w[0] for w in ways], "audits": [None if w is None else w[1] for w in ways],
    }


def _schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def _repair(schema: pa.Schema, with_turns: bool, size: int):
    """A partition in order of conversation and turn, as reports and segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        current, first, seq = object(), True, 0
        counts, turns, faults, held = _Counts(), [], [], 0

        def cut() -> None:
            nonlocal counts, turns, faults, held, seq
            out.append(_segment(current, seq, counts, turns, faults))
            counts, turns, faults, held, seq = _Counts(), [], [], 0, seq + 1

        def close(last: bool) -> None:
            """The end of a conversation; the first and the last of a partition may have other parts elsewhere."""
            nonlocal counts, turns, faults, held, seq, first
            if first or last or seq:
                cut()
            else:
                out.append(_whole(current, counts, turns, faults, with_turns))
            counts, turns, faults, held, seq, first = _Counts(), [], [], 0, 0, False

        begun = False
        for batch in batches:
            for conv_id, turn, role, text, copies, fault, later in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "fault", "later"))):
                if begun and conv_id != current:
                    close(False)
                current, begun = conv_id, True
                for k in range(copies):
                    its = DUPLICATE if fault != BLANK and (later or k) else fault
                    counts.add(turn, role[:1], its)
                    own = "" if its in (BLANK, DUPLICATE) else text  # always deleted
                    turns.append((role, own))
                    faults.append((role[:1], its))
                    held += len(own)
                    if len(turns) >= size or held >= SEGMENT_BYTES:
                        cut()
                        if len(out) >= 64:
                            yield pa.RecordBatch.from_pylist(out, schema=schema)
                            out.clear()
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out.clear()
        if begun:
            close(True)
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _fold(schema: pa.Schema):
    """Segments in order of conversation and place: the cheapest way through all, and the state before each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, begun = None, False
        counts, ways, places = _Counts(), {}, []

        def ended() -> pa.RecordBatch:
            (cost, audit), state, way = min((ways[q] for q in FINAL if q in ways), key=lambda w: w[0])
            states = []
            for pid, seq in reversed(places):
                before, way = way
                states.append({"pid": pid, "seq": seq, "before": before, "after": state})
                state = before
            return pa.RecordBatch.from_pylist([_report(current, counts, cost, audit, None) | {"states": states}], schema=schema)

        for batch in batches:
            for conv_id, pid, seq, part, costs, audits in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "pid", "seq", "counts", "costs", "audits"))):
                if not begun or conv_id != current:
                    if begun:
                        yield ended()
                    current, begun = conv_id, True
                    counts, ways, places = _Counts(), {START: ((0, ""), START, None)}, []
                counts.join(_of(part))
                places.append((pid, seq))
                after: dict = {}  # state: label, the state, (state before, its way)
                for p, ((cost, audit), _, states) in ways.items():
                    for q in STATES:
                        if (price := costs[4 * p + q]) is None:
                            continue
                        way = (cost + price, audit + audits[4 * p + q])
                        if q not in after or way < after[q][0]:
                            after[q] = way, q, (p, states)
                ways = after
        if begun:
            yield ended()

    return run


def _joined(schema: pa.Schema, with_turns: bool):
    """Segments in order with the states around them: the hash (or the turns) of each repaired conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, begun, digest, place = None, False, hashlib.sha256(), 0
        for batch in batches:
            out = []
            for conv_id, turns, audits, before, after in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turns", "audits", "before", "after"))):
                if not begun or conv_id != current:
                    if begun and not with_turns:
                        out.append({"own": current, "repaired_sha256": digest.hexdigest()})
                    current, begun, digest, place = conv_id, True, hashlib.sha256(), 0
                repaired, _ = apply_edits([(t["role"], t["text"]) for t in turns], audits[4 * before + after], before)
                for role, text in repaired:
                    if with_turns:
                        out.append({"conv_id": conv_id, "place": place, "role": role, "text": text})
                    else:
                        digest.update((("\n" if place else "") + f"{role}:{text}").encode())
                    place += 1
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if begun and not with_turns:
            yield pa.RecordBatch.from_pylist([{"own": current, "repaired_sha256": digest.hexdigest()}], schema=schema)

    return run


#: What separates words, for trimming.
_SPACE = " \t\n\v\f\r"


def _with_faults(rows: DataFrame) -> DataFrame:
    """Rows with `fault` (blank, truncated or none by themselves) and `later`: whether an earlier turn has the same role and text.

    Rows that are equal in turn, role and text become one with their copies.
    """
    tail = F.right(F.rtrim("text", F.lit(_SPACE)), F.lit(1))
    fault = F.when(tail == "", BLANK).when(tail.isin(".", "!", "?"), NONE).otherwise(TRUNCATED)
    same = F.md5(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.length("role").cast("string"), "role", "text").cast("binary"))
    rows = rows.select("conv_id", "turn", "role", "text", "copies", fault.cast("int").alias("fault"), same.alias("same"))
    when = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = rows.groupBy("same").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"), F.min(F.when(F.col("copies") > 0, when)).alias("first"))
    again = counted(materialize(again.where("rows > 1").select("same", "first"), "again"))
    marked = rows.join(again, "same", "left")
    later = F.coalesce(F.col("first") < when, F.lit(False))
    marked = marked.select("conv_id", "turn", "role", "text", "copies", "fault", later.alias("later"), "same", F.col("first").isNotNull().alias("several"))
    merged = marked.where("several").groupBy("conv_id", "turn", "role", "same", "fault", "later").agg(F.first("text").alias("text"), F.sum("copies").alias("copies"))
    columns = ("conv_id", "turn", "role", "text", "copies", "fault", "later")
    return marked.where("not several").select(*columns).unionByName(merged.select(*columns))


def _passed(rows: DataFrame, with_turns: bool, size: int) -> DataFrame:
    text_batches(rows.sparkSession)
    rows = _with_faults(rows)
    rows = rows.withColumn("head", F.left("text", F.lit(64)))
    rows = rows.repartitionByRange("conv_id", "turn", "role", "head").sortWithinPartitions("conv_id", "turn", "role", "text")
    return materialize(rows.drop("head").mapInArrow(_repair(_schema(_PASS), with_turns, size), _PASS), "repairs")


def _named(rows: DataFrame) -> DataFrame:
    plain = {"conv_id": F.col("conv_id").cast("long"), "turn": F.col("turn").cast("long"), "role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))}
    copies = F.col("copies").cast("int") if "copies" in rows.columns else F.lit(1)
    return rows.select(*(c.alias(n) for n, c in plain.items()), copies.alias("copies"))


def _in_order(segments: DataFrame) -> DataFrame:
    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "pid", "seq")


def _folded(segments: DataFrame) -> DataFrame:
    """Reports (without hash) of cut conversations, with the state after each segment."""
    narrow = _in_order(segments.select("conv_id", "pid", "seq", "counts", "costs", "audits"))
    return materialize(narrow.mapInArrow(_fold(_schema(_FOLD)), _FOLD), "folded")


def _rejoined(segments: DataFrame, folded: DataFrame, ddl: str, with_turns: bool) -> DataFrame:
    """What `_joined` makes of the segments of cut conversations in order."""
    way = folded.select(F.col("conv_id").alias("own"), F.explode("states").alias("way")).select("own", "way.*")
    way = way.withColumnsRenamed({"pid": "its_pid", "seq": "its_seq"})
    one = F.col("conv_id").eqNullSafe(F.col("own")) & (F.col("pid") == F.col("its_pid")) & (F.col("seq") == F.col("its_seq"))
    both = segments.join(way, one).select("conv_id", "pid", "seq", "turns", "audits", "before", "after")
    return _in_order(both).mapInArrow(_joined(_schema(ddl), with_turns), ddl)


def repair_conversations(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row for each conv_id of `rows` (conv_id, turn, role, text): faults, cost, audit and hash of its repair.

    Turns are taken by turn (nulls first), ties by role, then text; a null
    role or text is empty.  An optional column `copies` says how often a row
    stands there; a conversation whose rows all have 0 copies has no turns and
    is returned with zeros, an empty audit and the hash of the empty text.
    Rows with a null conv_id are one conversation.  gaps counts the missing
    turns between the least and the greatest; each turn's first fault of
    blank, duplicate (role and text seen earlier) and truncated counts;
    illegal are neighbours that the grammar doesn't allow.  Keep costs 0,
    rerole to user or assistant 1, delete 2 (the only edit of a blank or
    duplicate), insert an empty user or assistant 5, and truncated turns that
    stay 5 more.  Repeated rows are duplicates, an empty table gives an empty
    result, texts of any length are hashed whole; other columns are ignored.
    """
    passed = _passed(_named(rows), False, segment)
    segments = passed.where("seq is not null")
    folded = _folded(segments)
    hashes = _rejoined(segments, folded, "own long, repaired_sha256 string", False)
    cut = folded.drop("repaired_sha256").join(hashes, F.col("conv_id").eqNullSafe(F.col("own")))
    columns = [f.split()[0] for f in _REPORT.split(", ")]
    return passed.where("seq is null").select(*columns).unionByName(cut.select(*columns))


def repaired_turns(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, place, role, text): the turns of the repaired conversations; see `repair_conversations`."""
    passed = _passed(_named(rows), True, segment)
    whole = passed.where("seq is null").select("conv_id", F.posexplode("repaired").alias("place", "turn")).select("conv_id", "place", "turn.*")
    segments = passed.where("seq is not null")
    return whole.unionByName(_rejoined(segments, _folded(segments), "conv_id long, place int, role string, text string", True))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) with a fifth of all rows each dropped, emptied, cut, doubled or renamed.

    By crc32 of `conv_id:turn` modulo 20: 0 drops a row (0 copies), 1 empties
    its text, 2 removes its full stops, 3 doubles it, 4 makes its role user;
    other rows stay.  A null is one space, in that key as in role and text.
    """
    space = lambda c: F.coalesce(c, F.lit(" "))
    key = F.concat(space(F.col("conv_id").cast("string")), F.lit(":"), space(F.col("turn").cast("string")))
    rows = conversations.select("conv_id", "turn", space(F.col("role")).alias("role"), space(F.col("text")).alias("text"), (F.crc32(key) % 20).alias("lot"))
    text = F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("lot") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("lot") == 0, 0).when(F.col("lot") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))
