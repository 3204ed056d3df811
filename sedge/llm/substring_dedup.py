"""Substring deduplication over a compacted de Bruijn graph of words.

The k-mers (k = 50 words) of all texts are the edges of a de Bruijn graph.
Writing every edge of a corpus would cost many times its size, so edges travel
in bundles: the consecutive edges of a text that have the same minimizer (the
least hashed 8-word sequence within the edge) form one path, and the same path
in several texts compacts into one node by a grouped join on two independent
64-bit digests of its words.

Only where a minimizer continues in different ways, at the ends of a repeat or
around an edit, is a path opened into its edges.  There the graph is built:
nodes are sequences of k - 1 words, and a node through which more than one
edge comes or goes, or where a path begins or ends, is a branch.  A join with
the branches cuts each text's walk into nonbranching paths, which every text
walks whole, and equal ones compact by their first edge.

The least source (document, word position) of each path travels along; paths
of a text with one source and one shift are glued into long spans, and a span
counts only if the words at its source's coordinates are the words of the text
(compared by a 128-bit cryptographic digest of the words themselves).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import MAX_BROADCAST_IDS, anti_reduce, counted, discard, materialize, semi_reduce, text_batches
from .words import Words, mix, powers, slices, strings, word_table

#: Words of a minimizer.
SEED_WORDS = 8
#: Spans of one source from which on its digest goes to the spans.
HOT = 2000

_STEP = (np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25))
_INVERSE = tuple(np.uint64(pow(int(s), -1, 1 << 64)) for s in _STEP)


class Digests:
    """Digests of any run of words of a slice from prefix sums, in two lanes."""

    def __init__(self, words: Words):
        n = len(words.hash)
        self.lanes = []
        for w, step, inverse in zip((words.hash, words.hash2), _STEP, _INVERSE):
            total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(w * powers(n, step), dtype=np.uint64, out=total[1:])
            self.lanes.append((total, powers(n + 1, inverse)))

    def of(self, start: np.ndarray, end: np.ndarray, salt: np.ndarray | int = 0) -> list[np.ndarray]:
        salt = np.asarray(salt, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return [mix((total[end] - total[start]) * back[start] + salt) for total, back in self.lanes]


def minimizer(seed: np.ndarray, width: int) -> np.ndarray:
    """Leftmost position of the least of seed[i : i + width], for each i."""
    at = np.arange(len(seed))
    span = 1
    while span * 2 <= width:
        left, right = at[:-span], at[span:]
        at = np.where(seed[right] < seed[left], right, left)
        span *= 2
    if span < width:
        left, right = at[: len(at) - (width - span)], at[width - span :]
        at = np.where(seed[right] < seed[left], right, left)
    return at


def _paths(k: int):
    """Bundles of consecutive edges: a row for each run with one minimizer."""
    seed_words = min(SEED_WORDS, k)
    names = ["doc_id", "rk", "seed", "d1", "d2", "start", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = strings(batch.column("text"))
            for at, rows in slices(text):
                w = word_table(text.slice(at, rows))
                edges = len(w.hash) - k + 1
                if edges <= 0:
                    continue
                doc = np.repeat(np.arange(rows), np.diff(w.ptr))
                digests = Digests(w)
                place = np.arange(len(w.hash) - seed_words + 1)
                seed = digests.of(place, place + seed_words)[0]
                best = minimizer(seed, k - seed_words + 1)[:edges]
                valid = doc[:edges] == doc[k - 1 :]
                fresh = np.ones(edges, dtype=bool)
                fresh[1:] = (best[1:] != best[:-1]) | ~valid[:-1] | (doc[1:edges] != doc[: edges - 1])
                first = np.flatnonzero(fresh & valid)
                if not len(first):
                    continue
                # runs end before the next fresh or invalid edge
                stop = np.append(np.flatnonzero(fresh | ~valid), edges)
                size = stop[np.searchsorted(stop, first, side="right")] - first
                d1, d2 = digests.of(first, first + size + k - 1, size * (k + 1) + (best[first] - first))
                own = doc[first]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, rows).take(pa.array(own)),
                        batch.column("rk").slice(at, rows).take(pa.array(own)),
                        *(pa.array(x.view(np.int64)) for x in (seed[best[first]], d1, d2)),
                        pa.array((first - w.ptr[own]).astype(np.int32)),
                        pa.array(size.astype(np.int32)),
                    ],
                    names=names,
                )

    return run


def _edges(k: int):
    """The walks over the opened paths of a text ("paths": start, n).

    A row for each edge with the node behind it and the edge that follows, and
    one without an edge for the node where a walk begins.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = strings(batch.column("text"))
            for at, rows in slices(text):
                w = word_table(text.slice(at, rows))
                digests = Digests(w)
                for r in range(rows):
                    paths = batch.column("paths")[at + r].values
                    begin, many = (paths.field(c).to_numpy().astype(np.int64) for c in ("start", "n"))
                    place = np.unique(np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(int(many.sum())))
                    first = np.append(True, np.diff(place) > 1)
                    word = place + w.ptr[r]
                    e1, e2 = digests.of(word, word + k)
                    node = np.append(digests.of(word + 1, word + k)[0], digests.of(word[first], word[first] + k - 1)[0])
                    n, heads = len(place), int(first.sum())
                    follows = np.append(e1[1:], np.uint64(0))
                    last = np.append(first[1:], True)
                    none = np.append(np.zeros(n, bool), np.ones(heads, bool))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(n + heads, batch.column("doc_id")[at + r].as_py())),
                            pa.array(np.full(n + heads, batch.column("rk")[at + r].as_py())),
                            pa.array(np.append(place, place[first] - 1).astype(np.int32)),
                            pa.array(node.view(np.int64)),
                            pa.array(np.append(e1, np.zeros(heads, np.uint64)).view(np.int64), mask=none),
                            pa.array(np.append(e2, np.zeros(heads, np.uint64)).view(np.int64), mask=none),
                            pa.array(np.append(follows, e1[first]).view(np.int64), mask=np.append(last, np.zeros(heads, bool))),
                        ],
                        names=["doc_id", "rk", "start", "node", "e1", "e2", "follows"],
                    )

    return run


def _nonbranching(edges: DataFrame) -> DataFrame:
    """(doc_id, rk, start, n, first, last): the walks of `edges` cut at every branch."""
    ways = edges.groupBy("node").agg(
        F.count("*").alias("n"), F.count("e1").alias("ins"), F.count("follows").alias("outs"),
        (F.min("e1") < F.max("e1")).alias("many_in"), (F.min("follows") < F.max("follows")).alias("many_out"),
    )
    branches = materialize(ways.where("n > ins OR n > outs OR many_in OR many_out").select("node", F.lit(True).alias("cut")), "branches")
    walks = _with_branches(edges.where("e1 IS NOT NULL"), branches)
    order = Window.partitionBy("doc_id", "rk").orderBy("start")
    before = F.coalesce(F.lag("start").over(order), F.lit(-2))  # the same where a row of text is repeated
    begins = (F.coalesce(F.lag("cut").over(order), F.lit(False)) & (before < F.col("start"))) | (before + 1 < F.col("start"))
    walks = walks.withColumn("begins", begins).withColumn("path", F.sum(F.col("begins").cast("int")).over(order))
    ends = [F.min_by("e1", "start").alias("first"), F.min_by("e2", "start").alias("first2"), F.max_by("e1", "start").alias("last")]
    return walks.groupBy("doc_id", "rk", "path").agg(F.min("start").alias("start"), (F.max("start") - F.min("start") + 1).alias("n"), *ends).drop("path")


def _with_branches(walks: DataFrame, branches: DataFrame) -> DataFrame:
    """`walks` with `cut` where a node is a branch; branches go to the walks up to MAX_BROADCAST_IDS."""
    few = branches.count() <= MAX_BROADCAST_IDS
    return walks.join(F.broadcast(branches) if few else branches, "node", "left")


def _sourced(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, source, source_rk, source_start, last) of equal paths: the least document and where it has them."""
    of_least = [F.min_by(c, "doc_id").alias(f"source_{c}") for c in ("rk", "start")]
    return rows.groupBy(*keys).agg(F.min("doc_id").alias("source"), *of_least, F.max("doc_id").alias("last_doc"))


def _digest(words: np.ndarray) -> bytes:
    """A digest of the words in a stretch of text, whatever white space parts them."""
    return hashlib.blake2b(b" ".join(words.tobytes().split()), digest_size=16).digest()


def _source_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source, source_rk, source_start, size, digest, n) of the spans that are asked of a text, n times each."""
    for batch in batches:
        text = strings(batch.column("text"))
        for at, rows in slices(text):
            w = word_table(text.slice(at, rows))
            for r in range(rows):
                asked = batch.column("asked")[at + r].values
                start, size, many = (asked.field(c).to_numpy().astype(np.int64) for c in ("start", "size", "n"))
                a, n = int(w.ptr[r]), len(start)
                found = [_digest(w.data[w.start[a + i] : w.end[a + i + m - 1]]) for i, m in zip(start.tolist(), size.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, batch.column("doc_id")[at + r].as_py())),
                        pa.array(np.full(n, batch.column("rk")[at + r].as_py())),
                        pa.array(start.astype(np.int32)),
                        pa.array(size.astype(np.int32)),
                        pa.array(found, pa.binary()),
                        pa.array(many),
                    ],
                    names=["source", "source_rk", "source_start", "size", "digest", "n"],
                )


def _cut(n_names: list[str]):
    """Texts without the words of their spans that equal their source; counts of words and of removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = strings(batch.column("text"))
            null = batch.column("text").is_null().to_pylist()
            spans = batch.column("spans")
            for at, rows in slices(text):
                out, counts, removed = [], [], []
                marked = any(spans[at + r].is_valid for r in range(rows))
                w = word_table(text.slice(at, rows)) if marked else None
                for r in range(rows):
                    own = spans[at + r].as_py() if marked else None
                    if not own:
                        whole = text[at + r].as_py()
                        out.append(None if null[at + r] else whole)
                        counts.append(len(whole.encode().split()))
                        removed.append(0)
                        continue
                    a, b = int(w.ptr[r]), int(w.ptr[r + 1])
                    gone = np.zeros(b - a + 1, dtype=np.int64)
                    for s in own:
                        if _digest(w.data[w.start[a + s["start"]] : w.end[a + s["end"] - 1]]) == s["digest"]:
                            gone[s["start"]] += 1
                            gone[s["end"]] -= 1
                    gone = np.cumsum(gone[:-1]) > 0
                    # runs of removed words go with the white space after them
                    edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                    pieces, last = [], int(w.row[r])
                    for i, j in zip(edge[::2].tolist(), edge[1::2].tolist()):
                        pieces.append(w.data[last : w.start[a + i]].tobytes())
                        last = int(w.start[a + j]) if a + j < b else int(w.end[b - 1])
                    pieces.append(w.data[last : w.row[r + 1]].tobytes())
                    out.append(b"".join(pieces).decode())
                    counts.append(b - a)
                    removed.append(int(gone.sum()))
                kept = [batch.column(c).slice(at, rows) for c in n_names]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(out, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())],
                    names=[*n_names, "text", "n_words", "n_removed"],
                )

    return run


def repeated_spans(docs: DataFrame, k: int = 50) -> DataFrame:
    """(doc_id, rk, spans) of the rows of `docs` that may lose words.

    `docs` has doc_id, text and rk, a hash that tells rows of one id apart.
    spans: array of (start, end, digest), word positions with `end` exclusive
    and the digest of the words at the span's source.
    """
    text = docs.where("text is not null and doc_id is not null").select("doc_id", "rk", "text")
    paths = materialize(text.mapInArrow(_paths(k), "doc_id long, rk long, seed long, d1 long, d2 long, start int, n int"), "paths")
    nodes = materialize(_sourced(paths, ["seed", "d1", "d2"]), "nodes")
    seeds = nodes.groupBy("seed").agg(F.min("source").alias("low"), F.max("last_doc").alias("high"), F.count("*").alias("variants")).where("low < high")
    shared = nodes.join(seeds, "seed").where("source < last_doc or (variants > 1 and low < high)").drop("low", "high", "last_doc")
    met = materialize(paths.join(shared, ["seed", "d1", "d2"]), "met")
    discard(paths, nodes)

    opened = met.where("doc_id = source and variants > 1").groupBy("doc_id", "rk").agg(F.collect_list(F.struct("start", "n")).alias("paths"))
    opened = materialize(opened, "opened")
    ids = opened.select("doc_id").distinct()
    near = semi_reduce(text, ids, "doc_id", ids.count()).join(opened, ["doc_id", "rk"])
    edges = materialize(near.mapInArrow(_edges(k), "doc_id long, rk long, start int, node long, e1 long, e2 long, follows long"), "edges")
    compact = materialize(_nonbranching(edges), "compact")
    discard(opened, edges)
    same = ["first", "first2", "last", "n"]
    single = compact.join(_sourced(compact, same).where("source < last_doc"), same)

    # paths with one source and one shift that touch become one span
    columns = ["doc_id", "rk", "start", (F.col("start") + F.col("n") + (k - 1)).alias("end"), "source", "source_rk", (F.col("start") - F.col("source_start")).alias("shift")]
    found = met.where("source < doc_id").select(*columns).unionByName(single.where("source < doc_id").select(*columns))
    line = Window.partitionBy("doc_id", "rk", "source", "source_rk", "shift").orderBy("start", "end")
    reach = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("apart", (F.coalesce(reach, F.lit(-1)) < F.col("start")).cast("int")).withColumn("span", F.sum("apart").over(line))
    spans = found.groupBy("doc_id", "rk", "source", "source_rk", "shift", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    place = (F.col("start") - F.col("shift")).alias("source_start")
    spans = materialize(spans.select("doc_id", "rk", "start", "end", "source", "source_rk", place, (F.col("end") - F.col("start")).alias("size")), "spans")
    discard(met, compact)

    asked = spans.groupBy(F.col("source").alias("doc_id"), F.col("source_rk").alias("rk"), F.col("source_start").alias("start"), "size").agg(F.count("*").alias("n"))
    asked = asked.select("doc_id", "rk", F.struct("start", "size", "n").alias("x"))
    asked = materialize(asked.groupBy("doc_id", "rk").agg(F.collect_list("x").alias("asked")), "asked")
    ids = asked.select("doc_id").distinct()
    sources = semi_reduce(text, ids, "doc_id", ids.count()).join(asked, ["doc_id", "rk"])
    place = ["source", "source_rk", "source_start", "size"]
    digests = sources.mapInArrow(_source_digests, "source long, source_rk long, source_start int, size int, digest binary, n long")
    digests = materialize(digests.groupBy(*place).agg(F.first("digest").alias("digest"), F.max("n").alias("n")), "digests")  # rows of text may repeat
    # what very many spans ask for goes to them, so that they aren't dealt to one task
    hot = counted(digests.where(F.col("n") > HOT).drop("n"))
    rest = spans.join(hot, place, "left_anti").join(digests.where(F.col("n") <= HOT).drop("n"), place)
    known = spans.join(hot, place).unionByName(rest)
    return known.groupBy("doc_id", "rk").agg(F.sort_array(F.collect_list(F.struct("start", "end", "digest"))).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 50, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, `keep` columns, text, n_words, n_removed of every row of `docs`.

    Removed is each word covered by a window of `k` consecutive words whose
    word sequence also starts in a row with a smaller id; windows are judged
    on the input.  Words are matched unchanged.  A removed run goes with the
    white space after it, all other white space stays.

    A null text stays null and has 0 words; texts shorter than `k` words lose
    nothing.  An empty table gives an empty result, a text of any length is
    taken whole.  Rows with one id, repeated or not, don't remove each other's
    words; rows with a null id neither lose words nor remove any.  Columns of
    `keep` with the names of results are replaced.
    """
    text_batches(docs.sparkSession)
    keep = tuple(c for c in keep if c not in ("doc_id", "text", "n_words", "n_removed"))
    held = F.struct(*(F.col(c) for c in keep)) if keep else F.lit(None).cast("int")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), held.alias("kept"))
    base = base.withColumn("rk", F.xxhash64("doc_id", "text"))
    spans = materialize(repeated_spans(base, k), "spans")
    ids = spans.select("doc_id").distinct()
    n_ids = ids.count()
    hit = semi_reduce(base, ids, "doc_id", n_ids).join(spans, ["doc_id", "rk"], "left")
    rest = anti_reduce(base, ids, "doc_id", n_ids).withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
    names = ["doc_id", "kept"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.select(*names).schema) + ", text string, n_words long, n_removed long"
    columns = [*names, "text", "spans"]
    out = hit.select(*columns).mapInArrow(_cut(names), schema).unionByName(rest.select(*columns).mapInArrow(_cut(names), schema))
    return out.select("doc_id", *(F.col("kept")[c].alias(c) for c in keep), "text", "n_words", "n_removed")
