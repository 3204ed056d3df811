"""Prefix tries of conversations, as ternary search trees over range shards.

Every distinct sequence of first turns is a node.  Conversations that are
equal to the end are counted first, so one of them stands for all in the trie.
Their sequences are dealt in order of their turns, and each task cuts its
range into shards of at most SHARD turns: the turns of a shard are encoded by
a dictionary, its sequences inserted into a ternary search tree in the order
of medians (which balances it), and one iterative traversal accumulates
members, children, leaves and savings from the bottom.

A node whose sequences all lie in one shard is final.  Others lie on the path
of the shard's first or last sequence; these two paths, with what hangs off
them, are the sequences of a further, much smaller round, until one shard is
left.  Sequences are taken in pieces of PIECE turns: deeper pieces are tries
of their own below a node, built first; where one conversation is alone, its
further turns are nodes without a search.  So no task holds a conversation or
a group of copies, only pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import counted, materialize

#: Turns of a piece of a conversation at most.
PIECE = 256
#: Turns of the sequences of a shard at most (but LEAST sequences, so that each round has fewer); sequences of a further round that one task takes.
SHARD, LEAST, TOP = 200_000, 8, 2_000


class TernaryTree:
    """A ternary search tree over sequences of integers; nodes are numbered as they are created."""

    def __init__(self) -> None:
        self.symbol: list[int] = []
        self.less: list[int] = []
        self.equal: list[int] = []
        self.more: list[int] = []
        self.above: list[int] = []  # the node of the prefix, -1 for a first symbol
        self.root = -1

    def _new(self, symbol: int, above: int) -> int:
        for links in (self.less, self.equal, self.more):
            links.append(-1)
        self.symbol.append(symbol)
        self.above.append(above)
        return len(self.symbol) - 1

    def insert(self, symbols: list[int]) -> list[int]:
        """The nodes of all prefixes of a sequence."""
        path, above = [], -1
        links, at = None, 0  # where the next link is read and set
        for symbol in symbols:
            node = self.root if links is None else links[at]
            while node >= 0 and self.symbol[node] != symbol:
                links, at = (self.less if symbol < self.symbol[node] else self.more), node
                node = links[at]
            if node < 0:
                node = self._new(symbol, above)
                if links is None:
                    self.root = node
                else:
                    links[at] = node
            path.append(node)
            above, links, at = node, self.equal, node
        return path

    def top_down(self) -> list[int]:
        """All nodes, prefixes before what extends them."""
        order, open_ = [], [self.root] if self.root >= 0 else []
        while open_:
            node = open_.pop()
            order.append(node)
            open_ += [link for link in (self.less[node], self.more[node], self.equal[node]) if link >= 0]
        return order


def median_order(n: int) -> Iterator[int]:
    """0 .. n - 1, the middle of each interval before its halves."""
    open_ = [(0, n)]
    while open_:
        low, high = open_.pop(0) if len(open_) < 64 else open_.pop()
        if low < high:
            middle = (low + high) // 2
            yield middle
            open_ += [(low, middle), (middle + 1, high)]


#: What hangs at a node apart from its prefix's extensions in the trie: members, the least of them, children, leaves, savings, hash of the members that end there.
_HERE = "array<struct<at:int,n:long,conv:long,kids:long,leaves:long,saved:long,ends:string>>"
_RECORD = f"ga long, gb long, seq array<struct<a:long,b:long,w:int>>, here {_HERE}"
_NODE = "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, a long, b long, above_a long, above_b long"
_SHARD = f"{_NODE}, pid int, nth int, {_RECORD}"


class _Shard:
    """The trie of some neighbouring sequences (of one group: below one node)."""

    def __init__(self, records: list[tuple], depth: int):
        self.depth, self.records = depth, records
        self.tree = tree = TernaryTree()
        symbols = [(ga, gb) for ga, gb, _, _ in records] + [(s["a"], s["b"]) for _, _, seq, _ in records for s in seq]
        codes = {symbol: i for i, symbol in enumerate(sorted(set(symbols)))}
        spelled = list(codes)
        paths: list[list[int]] = [[]] * len(records)
        here: dict[int, list] = {}
        words: dict[int, int] = {}
        for i in median_order(len(records)):
            ga, gb, seq, held = records[i]
            paths[i] = path = tree.insert([codes[ga, gb], *(codes[s["a"], s["b"]] for s in seq)])
            words.update((node, s["w"]) for node, s in zip(path[1:], seq))
            for h in held:
                node = path[h["at"]]
                mine = here.setdefault(node, [0, None, 0, 0, 0, None])
                self._join(mine, h["n"], h["conv"], h["kids"], h["leaves"], h["saved"])
                mine[5] = h["ends"] if mine[5] is None else mine[5]
        self.paths, self.here, self.words, self.spelled = paths, here, words, spelled

    @staticmethod
    def _join(mine: list, n: int, conv: int | None, kids: int, leaves: int, saved: int) -> None:
        mine[0] += n
        mine[1] = conv if mine[1] is None or (conv is not None and conv < mine[1]) else mine[1]
        mine[2] += kids
        mine[3] += leaves
        mine[4] += saved

    def rows(self, last: bool) -> Iterator[dict]:
        """Final nodes, then (unless this is the last round) the two paths of the ends."""
        tree, here = self.tree, self.here
        edges = set() if last else {*self.paths[0], *self.paths[-1]}
        order = tree.top_down()
        key: dict[int, tuple[int, int]] = {}
        level: dict[int, int] = {}
        for node in order:
            a, b = self.spelled[tree.symbol[node]]
            if (above := tree.above[node]) >= 0:
                a, b = a ^ key[above][0], b ^ key[above][1]
            key[node], level[node] = (a, b), level[above] + 1 if above >= 0 else 0
        for node in reversed(order):
            mine = here.setdefault(node, [0, None, 0, 0, 0, None])
            if node in edges:
                continue
            mine[3] += mine[2] == 0
            mine[4] += (mine[0] - 1) * self.words.get(node, 0)
            if (above := tree.above[node]) >= 0:
                self._join(here.setdefault(above, [0, None, 0, 0, 0, None]), mine[0], mine[1], 1, mine[3], mine[4])
        for node in order:
            if node not in edges:
                n, conv, kids, leaves, saved, ends = here[node]
                above = tree.above[node]
                parent = here[above][1] if above >= 0 and above not in edges and level[above] else None
                at = key[above] if above >= 0 else (None, None)
                yield {
                    "conv_id": conv, "depth": self.depth + level[node], "parent_conv_id": parent, "n_convs": n, "n_children": kids, "n_leaves": leaves,
                    "saved_tokens": saved, "ends": ends, "a": key[node][0], "b": key[node][1], "above_a": at[0], "above_b": at[1],
                }
        done: set[int] = set()
        names = ("at", "n", "conv", "kids", "leaves", "saved", "ends")
        for i in () if last else sorted({0, len(self.records) - 1}):
            ga, gb, seq, _ = self.records[i]
            held = [dict(zip(names, (at, *here[node]))) for at, node in enumerate(self.paths[i]) if node not in done]
            done.update(self.paths[i])
            yield {"ga": ga, "gb": gb, "seq": seq, "here": held}


def _sharded(schema: pa.Schema, depth: int, last: bool, size: int):
    """Sequences in order, as shards of at most `size` turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, turns, nth = [], 0, 0
        pid = TaskContext.get().partitionId()

        def built() -> Iterator[pa.RecordBatch]:
            nonlocal nth
            out = []
            for row in _Shard(held, depth).rows(last):
                if "seq" in row:
                    row |= {"pid": pid, "nth": nth}
                    nth += 1
                out.append(row)
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out.clear()
            yield pa.RecordBatch.from_pylist(out, schema=schema)

        for batch in batches:
            for record in zip(*(batch.column(c).to_pylist() for c in ("ga", "gb", "seq", "here"))):
                if len(held) >= LEAST and not last and turns + len(record[2]) + 1 > size:
                    yield from built()
                    held.clear()
                    turns = 0
                held.append(record)
                turns += len(record[2]) + 1
        if held:
            yield from built()

    return run


def _schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def build_tries(records: DataFrame, depth: int, size: int = SHARD, top: int = TOP) -> tuple[DataFrame, DataFrame]:
    """(nodes, nodes of later rounds) of the tries of `records` (ga, gb: the node above; seq; here), whose roots are at `depth`.

    Nodes without parent_conv_id have above_a, above_b, the key of their
    parent; that parent is a root or a node of a later round.
    """
    out, late = None, None
    level = records.repartitionByRange("ga", "gb", "seq").sortWithinPartitions("ga", "gb", "seq")
    last, before, a_task = False, None, top
    while True:
        done = materialize(level.mapInArrow(_sharded(_schema(_SHARD), depth, last, size), _SHARD), "tries")
        nodes = done.where("conv_id is not null").select(*(f.split()[0] for f in _NODE.split(", ")))
        out = nodes if out is None else out.unionByName(nodes)
        late = late if out is nodes else nodes if late is None else late.unionByName(nodes)
        if last:
            return out, late
        paths = done.where("seq is not null").select("ga", "gb", "seq", "here")
        n = paths.count()
        last = n <= top
        if before is not None and 2 * n > before:  # parts of few sequences leave as many
            a_task *= 2
        before = n
        level = (paths.coalesce(1) if last else paths.repartitionByRange(-(-n // a_task), "ga", "gb", "seq")).sortWithinPartitions("ga", "gb", "seq")


# -- conversations as sequences ------------------------------------------------


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order with their place within the part of their conversation that this partition holds."""
    pid = TaskContext.get().partitionId()
    current, seen = None, 0
    for batch in batches:
        conv = batch.column("conv_id").to_numpy()
        n = len(conv)
        if not n:
            continue
        first = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
        place = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
        if conv[0] == current:
            place[: first[1] if len(first) > 1 else n] += seen
        current, seen = conv[-1], int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, pid, dtype=np.int32)), pa.array(place.astype(np.int64))], names=[*batch.schema.names, "pid", "place"])


def placed_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, place, digest, words) of turns (conv_id, turn, role, text), places from 0.

    Order is by turn (null first), then role, then the first 64 characters of
    the text, then a digest of both.  Turns are dealt by range of that order,
    so the turns of one conversation may stand in many tasks; a task counts
    its own, and what stands before them is added from the counts of parts.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    words = F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.left(text, F.lit(64)).alias("head"), digest.alias("digest"), words.alias("words")
    )
    rows = rows.repartitionByRange("conv_id", "turn", "role", "head", "digest").sortWithinPartitions("conv_id", "turn", "role", "head", "digest")
    kind = "conv_id long, digest binary, words int, pid int, place long"
    rows = materialize(rows.select("conv_id", "digest", "words").mapInArrow(_places, kind), "places")
    several = rows.groupBy("conv_id").agg(F.min("pid").alias("low"), F.max("pid").alias("high")).where("low < high")
    several = F.broadcast(materialize(several.select("conv_id"), "cut"))  # at most one for each end of a partition
    parts = rows.join(several, "conv_id").groupBy("conv_id", "pid").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(parts.select("conv_id", "pid", before.alias("before")))  # at most two for each partition
    return rows.join(offsets, ["conv_id", "pid"], "left").select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("place"), "digest", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns come from a common one, as places and lengths.

    The first h turns of conversation c are those of c - c % 20 (as far as it
    has them), with h = crc32(c) % 4; the others its own.  Returns (conv_id,
    place, digest, words) and (conv_id, length), also of those without a turn.
    """
    placed = materialize(placed_turns(turns), "placed")
    head = (F.crc32(F.col("conv_id").cast("string")) % 4).alias("h")
    convs = placed.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("base", F.col("conv_id") - F.col("conv_id") % 20)
    bases = convs.where("conv_id = base").select("base", F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left").select("conv_id", "base", "n", head, F.coalesce("base_n", F.lit(0)).alias("base_n"))
    convs = convs.withColumn("taken", F.least("h", "base_n"))
    convs = materialize(convs.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "lengths")
    own = placed.join(convs.select("conv_id", "h", "taken"), "conv_id").where("place >= h")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "digest", "words")
    heads = placed.where("place < 3 and conv_id % 20 = 0").select(F.col("conv_id").alias("base"), "place", "digest", "words")
    given = convs.where("taken > 0").select("conv_id", "base", "h").join(heads, "base").where("place < h").select("conv_id", "place", "digest", "words")
    return own.unionByName(given), convs.select("conv_id", "length")


def _xor(c: str) -> Column:
    return F.coalesce(F.bit_xor(c), F.lit(0)).alias(c)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of conversations in order of what they are and then of id: the first of each kind, how many, the hash of their ids."""
    current, first, n, digest = None, None, 0, None
    for batch in batches:
        out: list[list] = [[], [], []]

        def close() -> None:
            if current is not None:
                for column, value in zip(out, (first, n, digest.hexdigest())):
                    column.append(value)

        for a, b, conv_id in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "conv_id"))):
            if (a, b) != current:
                close()
                current, first, n, digest = (a, b), conv_id, 0, hashlib.sha256()
            digest.update((("," if n else "") + str(conv_id)).encode())
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["conv_id", "n", "ends"])
    if current is not None:
        yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([n], pa.int64()), pa.array([digest.hexdigest()])], names=["conv_id", "n", "ends"])


def prefix_trie(turns: DataFrame, lengths: DataFrame, piece: int = PIECE, shard: int = SHARD, top: int = TOP) -> DataFrame:
    """A row for every node of the trie of conversations.

    `turns` is (conv_id, place, digest, words), places from 0 without gaps;
    `lengths` (conv_id, length) has every conversation, those without a turn
    as well.  Returns conv_id (the least member), depth, parent_conv_id (the
    parent's; null at the root), n_convs, n_children, n_leaves, saved_tokens
    and ends_sha256 (of the ids that end there, ascending, comma-joined).
    A table without conversations has no node.

    Sequences are equal if two 64-bit hashes of digest and place agree.  Where
    different conversations share more than `piece` first turns, each further
    `piece` turns that any two share take one more round.
    """
    symbols = turns.select("conv_id", "place", F.xxhash64("digest", "place").alias("a"), F.xxhash64("place", F.lit("b"), "digest").alias("b"), "words")
    symbols = symbols.withColumn("piece", F.floor(F.col("place") / piece).cast("int"))
    sequence = F.sort_array(F.collect_list(F.struct("place", "a", "b", F.col("words").alias("w"))))
    pieces = symbols.groupBy("conv_id", "piece").agg(sequence.alias("turns"), _xor("a"), _xor("b"), F.sum("words").alias("words"))
    pieces = materialize(pieces.withColumn("turns", F.transform("turns", lambda t: F.struct(t["a"], t["b"], t["w"]))).withColumnRenamed("turns", "seq"), "pieces")

    # equal conversations: one stands for all
    whole = pieces.groupBy("conv_id").agg(_xor("a"), _xor("b"), F.sum("words").alias("all_words"))
    whole = lengths.join(whole, "conv_id", "left").select("conv_id", "length", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("a", "b", "all_words")))
    whole = materialize(whole, "whole")
    same = whole.select("a", "b", "conv_id").repartition("a", "b").sortWithinPartitions("a", "b", "conv_id")
    same = same.mapInArrow(_ends, "conv_id long, n long, ends string")
    kept = materialize(same.join(whole.select("conv_id", "length", "all_words"), "conv_id"), "kept")

    # each piece with the node above it (ga, gb) and the words up to its beginning
    by = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    long_ = pieces.join(kept.where(F.col("length") > piece).select("conv_id"), "conv_id", "left_semi")
    above = long_.select("conv_id", "piece", *(F.coalesce(F.bit_xor(c).over(by), F.lit(0)).alias(f"g{c}") for c in "ab"), F.coalesce(F.sum("words").over(by), F.lit(0)).alias("before"))
    above = materialize(above.where("piece > 0"), "above")
    groups = above.groupBy("piece", "ga", "gb").agg(F.count("*").alias("several")).where("several > 1")
    groups = counted(materialize(groups, "groups"))
    above = materialize(above.join(groups.select("piece", "ga", "gb", F.lit(True).alias("shared")), ["piece", "ga", "gb"], "left"), "shared")
    deepest = above.where("shared").agg(F.max("piece")).first()[0] or 0

    facts = kept.select("conv_id", "length", "n", "ends", "all_words")
    nodes, late, roots = None, None, None
    for k in range(deepest, -1, -1):
        rows = pieces.where(F.col("piece") == k)
        if k:
            mine = above.where((F.col("piece") == k) & F.col("shared")).select("conv_id", "ga", "gb")
            rows = rows.join(mine, "conv_id").join(facts, "conv_id")
        else:  # also those without a turn
            rows = facts.join(rows, "conv_id", "left").withColumns({"ga": F.lit(0).cast("long"), "gb": F.lit(0).cast("long")})
            rows = rows.withColumn("seq", F.coalesce("seq", F.array().cast("array<struct<a:bigint,b:bigint,w:int>>")))
        rows = rows.select("conv_id", "ga", "gb", "seq", "length", "n", "ends", "all_words")
        size, none = F.size("seq"), F.lit(0).cast("long")
        here = lambda n, conv, kids, leaves, saved, ends: F.array(F.struct(size.alias("at"), n.alias("n"), conv.alias("conv"), kids.alias("kids"), leaves.alias("leaves"), saved.alias("saved"), ends.alias("ends")))
        ended = rows.where(F.col("length") <= (k + 1) * piece).select("ga", "gb", "seq", here(F.col("n"), F.col("conv_id"), none, none, none, F.col("ends")).alias("here"))
        goes_on = rows.where(F.col("length") > (k + 1) * piece).join(
            above.where(F.col("piece") == k + 1).select("conv_id", F.col("ga").alias("na"), F.col("gb").alias("nb"), "before", "shared"), "conv_id"
        )
        saved = (F.col("n") - 1) * (F.col("all_words") - F.col("before"))
        one, null = F.lit(1).cast("long"), F.lit(None).cast("string")
        alone = goes_on.where("shared is null").select("ga", "gb", "seq", here(F.col("n"), F.col("conv_id"), one, one, saved, null).alias("here"))
        records = ended.unionByName(alone)
        if roots is not None:  # groups below: one of their conversations carries what their trie says
            first = goes_on.where("shared").groupBy("na", "nb").agg(F.min_by(F.struct("ga", "gb", "seq"), "conv_id").alias("one")).select("na", "nb", "one.*")
            first = first.join(roots, (F.col("na") == F.col("a")) & (F.col("nb") == F.col("b")))
            records = records.unionByName(first.select("ga", "gb", "seq", here(*(F.col(c) for c in ("n_convs", "conv_id", "n_children", "n_leaves", "saved_tokens")), null).alias("here")))
        made, later = build_tries(records, k * piece, shard, top)
        roots = made.where(F.col("depth") == k * piece)
        made = made.where(F.col("depth") > k * piece) if k else made
        later = later.where(F.col("depth") > k * piece) if k else later
        at_ends = made.where((F.col("depth") == (k + 1) * piece) & (F.col("depth") > 0))
        nodes, late = (made, later.unionByName(at_ends)) if nodes is None else (nodes.unionByName(made), late.unionByName(later).unionByName(at_ends))

    # turns of one conversation (and its equals) alone, below the first piece that no other has
    alone = above.where("shared is null").groupBy("conv_id").agg(F.min("piece").alias("piece"), F.min_by(F.struct("ga", "gb"), "piece").alias("g"))
    alone = materialize(alone.join(facts, "conv_id"), "alone")
    if alone.limit(1).count():
        tail = symbols.join(alone.select("conv_id", F.col("piece").alias("its"), "g", "length", "n", "ends", "all_words"), "conv_id").where("piece >= its")
        tail = tail.join(above.select("conv_id", "piece", "before"), ["conv_id", "piece"])
        within = Window.partitionBy("conv_id", "piece").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
        left = (F.col("n") - 1) * (F.col("all_words") - F.col("before") - F.coalesce(F.sum("words").over(within), F.lit(0)))
        top_turn = F.col("place") == F.col("its") * piece
        end = F.col("place") == F.col("length") - 1
        one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
        tail = tail.select(
            "conv_id", (F.col("place") + 1).cast("int").alias("depth"), F.when(~top_turn, F.col("conv_id")).alias("parent_conv_id"), F.col("n").alias("n_convs"), F.when(end, zero).otherwise(one).alias("n_children"),
            one.alias("n_leaves"), left.alias("saved_tokens"), F.when(end, F.col("ends")).alias("ends"), zero.alias("a"), zero.alias("b"),
            F.when(top_turn, F.col("g.ga")).alias("above_a"), F.when(top_turn, F.col("g.gb")).alias("above_b"),
        )
        nodes = nodes.unionByName(tail)

    parents = counted(materialize(late.select(F.col("a").alias("above_a"), F.col("b").alias("above_b"), F.col("conv_id").alias("parent")).distinct(), "parents"))
    asked = nodes.where("parent_conv_id is null and depth > 0").join(parents, ["above_a", "above_b"], "left")
    known = nodes.where("parent_conv_id is not null or depth = 0").withColumn("parent", F.col("parent_conv_id"))
    out = known.unionByName(asked.select(*known.columns))
    return out.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
