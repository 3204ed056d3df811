"""Near-duplicate detection with HyperMinHash sketches.

Each document's set of word shingles becomes one HyperMinHash sketch: every
shingle hash picks one of 128 buckets, and a bucket keeps the leading-zero
count and ten mantissa bits of its least remainder in 16 bits.  Sketches are
banded (32 bands of 4 registers, empty registers filled from other buckets
first), bands become join keys, and the collision-corrected Jaccard estimate
decides which candidates stay near enough to be verified on their full sets.

Nothing lists the pairs of a group:

* documents with equal sets collapse into one class first;
* a band bucket links its members to one pivot, and the links whose estimate
  is far below the threshold go; what is left falls into loose families;
* where members of several families stand in one bucket, those outside its
  largest family are estimated against all others of the bucket in blocks, so
  every pair that shares a bucket is in one family or has been found far apart;
* a family is verified in chunks of a bounded number of members and of
  shingles (their texts fetched by a join) and only spanning links leave a task;
* chunks meet through a few landmarks, and members that did not join their
  family's main component are compared with every other chunk.

A pair at the threshold shares no band with probability (1 - J^4)^32, which is
5e-11 at 0.85 and 5e-8 at 0.8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import discard, materialize, semi_reduce, text_batches
from .words import mix, slices, strings, word_table

BUCKET_BITS, MANTISSA_BITS = 7, 10
BUCKETS = 1 << BUCKET_BITS
BAND_ROWS = 4
BANDS = BUCKETS // BAND_ROWS
#: Links whose estimated similarity is below the threshold by this much go.
SLACK = 0.3
#: Members of a band bucket, on average, that meet as many others in one task.
BLOCK = 2048
#: Members of a family that one task compares with each other.
CHUNK = 384
#: Shingles of those members, on average (16 MB of hashes and as much text).
CHUNK_SHINGLES = 2_000_000
#: Members of each family that all of its chunks hold, on average.
LANDMARKS = 8
#: Constant of the expected register collisions in the HyperMinHash paper
#: (Yu and Weber, 2017).
COLLISION = 0.169919487159739093975315012348630288992889

_rng = np.random.default_rng(20170)
_PROBE = _rng.integers(0, BUCKETS, size=(1024, BUCKETS))
_SALT = _rng.integers(1, 2**63, size=(BANDS, BAND_ROWS), dtype=np.uint64) | np.uint64(1)


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text of a slice.

    Words are lower-cased (A-Z).  A text with 1 to size - 1 words has its whole
    sequence as one shingle, one without words has none.
    """
    w = word_table(column, lower=True)
    n = len(w.hash)
    mult = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    run = np.zeros(max(n - size + 1, 0), dtype=np.uint64)
    for j in range(size):
        run += mix(w.hash[j : j + len(run)] + mult[j])
        run *= np.uint64(0x9FB21C651E98DF25)
    run = mix(run)
    for a, b in zip(w.ptr[:-1].tolist(), w.ptr[1:].tolist()):
        if b - a >= size:
            yield np.unique(run[a : b - size + 1])
        elif b > a:
            short = np.array([b - a], dtype=np.uint64)
            for j in range(a, b):
                short = mix(short * np.uint64(0x9FB21C651E98DF25) + w.hash[j : j + 1])
            yield short
        else:
            yield np.zeros(0, dtype=np.uint64)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The HyperMinHash registers of a sorted set; 0 marks an empty bucket."""
    out = np.zeros(BUCKETS, dtype=np.uint16)
    if not len(hashes):
        return out
    bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    rest = (hashes[first] << np.uint64(BUCKET_BITS)) >> np.uint64(11)  # 53 bits: exact as double
    _, top = np.frexp(rest.astype(np.float64))
    shift = top.astype(np.int64) - 1 - MANTISSA_BITS
    up, down = np.maximum(-shift, 0).astype(np.uint64), np.maximum(shift, 0).astype(np.uint64)
    mantissa = ((rest << up) >> down) & np.uint64((1 << MANTISSA_BITS) - 1)
    zeros = np.uint64(53) - top.astype(np.uint64) + np.uint64(1)
    out[bucket[first]] = ((zeros << np.uint64(MANTISSA_BITS)) | mantissa).astype(np.uint16)
    return out


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """A key for each band of each sketch (rows of registers, none all empty)."""
    value = sketches.astype(np.uint64)
    donor = np.broadcast_to(np.arange(BUCKETS), value.shape).copy()
    full = sketches > 0
    for row in np.flatnonzero(~full.all(axis=1)):
        missing = np.flatnonzero(~full[row])
        for probe in _PROBE:
            found = full[row, probe[missing]]
            donor[row, missing[found]] = probe[missing[found]]
            missing = missing[~found]
            if not len(missing):
                break
        donor[row, missing] = np.flatnonzero(full[row])[0]
    value = np.take_along_axis(value, donor, axis=1) | (donor.astype(np.uint64) << np.uint64(16))
    value = mix(value).reshape(len(value), BANDS, BAND_ROWS)
    keys = np.zeros((len(value), BANDS), dtype=np.uint64)
    for j in range(BAND_ROWS):
        keys = mix(keys + value[:, :, j] * _SALT[:, j])
    return keys


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of paired sketches, less the expected collisions."""
    used = ((a > 0) | (b > 0)).sum(axis=1)
    same = ((a == b) & (a > 0)).sum(axis=1)
    both = (n_a + n_b).astype(float)
    chance = COLLISION * BUCKETS / 2.0**MANTISSA_BITS * 4.0 * n_a * n_b / np.maximum(both * both, 1.0)
    chance = np.minimum(chance, used / 2)
    return np.clip((same - chance) / np.maximum(used - chance, 1e-9), 0.0, 1.0)


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = strings(batch.column("text"))
            for at, n in slices(text):
                count, print_, regs = [], [], []
                for s in shingle_sets(text.slice(at, n), size):
                    count.append(len(s))
                    print_.append(hashlib.sha256(s.tobytes()).digest()[:16] if len(s) else None)
                    regs.append(registers(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, n), pa.array(count, pa.int64()), pa.array(print_, pa.binary()), pa.array(regs, pa.binary())],
                    names=["doc_id", "n", "print", "regs"],
                )

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(len(column), BUCKETS)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            keys = band_keys(_matrix(part.column("regs")))
            ids = np.repeat(part.column("id").to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids)], names=["band", "id"])


def _loose(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                near = estimate(*(_matrix(part.column(c)) for c in ("regs", "pregs")), *(part.column(c).to_numpy() for c in ("n", "pn")))
                part = part.select(["u", "v"]).filter(pa.array(near >= least))
                if part.num_rows:
                    yield part

    return run


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _across(least: float):
    """Links between the families of one bucket: guests (role 0) with hosts (role 1).

    Guests stand among the hosts too (`twice`); of two guests the lesser id asks.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, role, n, twice = (pdf[c].to_numpy() for c in ("id", "role", "n", "twice"))
        regs = _matrix(pa.array(pdf["regs"], pa.binary()))
        guests, hosts = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        names, code = np.unique(pdf["family"].to_numpy(), return_inverse=True)
        forest, links = _Forest(len(names)), []
        step = max(1, 8192 // max(len(hosts), 1))
        for at in range(0, len(guests), step):
            root = np.array([forest.find(c) for c in range(len(names))])[code]
            some = guests[at : at + step]
            i, j = np.repeat(some, len(hosts)), np.tile(hosts, len(some))
            open_ = (root[i] != root[j]) & (~twice[j] | (ids[i] < ids[j]))
            i, j = i[open_], j[open_]
            near = estimate(regs[i], regs[j], n[i], n[j]) >= least
            for a, b in zip(i[near].tolist(), j[near].tolist()):
                if forest.join(int(code[a]), int(code[b])):
                    links.append((ids[a], ids[b]))
        return pd.DataFrame({"u": np.array([a for a, _ in links], np.int64), "v": np.array([b for _, b in links], np.int64)})

    return run


def _bridges(shared: DataFrame, families: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """Links (u, v) between families (node, family) that meet in a bucket (band, id).

    The bucket's largest family waits as hosts, all other members are guests;
    guests and hosts meet in blocks, and one task holds two blocks at most.
    """
    members = shared.join(families.withColumnRenamed("node", "id"), "id", "left").withColumn("family", F.coalesce("family", "id"))
    mixed = members.groupBy("band").agg(F.min("family").alias("low"), F.max("family").alias("high")).where("low < high").select("band")
    members = materialize(members.join(mixed, "band"), "mixed")
    votes = members.groupBy("band", "family").agg(F.count("*").alias("votes"))
    main = votes.groupBy("band").agg(
        F.max(F.struct("votes", F.col("family").alias("main")))["main"].alias("main"), F.sum("votes").alias("all"), F.max("votes").alias("most")
    )
    blocks = lambda count: F.ceil(count / BLOCK).cast("int")
    main = main.select("band", "main", blocks(F.col("all")).alias("chunks"), blocks(F.col("all") - F.col("most")).alias("lots"))
    members = members.join(main, "band").join(reps.select("id", "n", "regs"), "id").withColumn("twice", F.col("family") != F.col("main"))
    lot = lambda seed, count: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(count).cast("long")).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    kept = ("id", "family", "n", "regs", "twice")
    guests = members.where("twice").select("band", lot(3, "lots").alias("part"), every("chunks").alias("chunk"), *kept, F.lit(0).alias("role"))
    hosts = members.select("band", every("lots").alias("part"), lot(4, "chunks").alias("chunk"), *kept, F.lit(1).alias("role"))
    return guests.unionByName(hosts).groupBy("band", "part", "chunk").applyInPandas(_across(least), "u long, v long")


def _verify(size: int, num: int, den: int):
    """Spanning links of one chunk: members (role 1) with guests (role 0), or
    with each other where there are no guests."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids, role, label = (pdf[c].to_numpy() for c in ("id", "role", "label"))
        text = pa.array(pdf["text"], pa.large_string())
        sets = [s for at, n in slices(text) for s in shingle_sets(text.slice(at, n), size)]
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        everything, code = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True)
        ends = np.cumsum(sizes)
        begin = ends - sizes
        forest, links = _Forest(len(ids)), []
        guests = np.flatnonzero(role == 0)
        paired = len(guests) > 0
        hosts = np.flatnonzero(role == 1)
        if paired:  # what is known to be connected needs one link at most
            for same in pd.Series(np.arange(len(ids))).groupby(label).indices.values():
                for j in same[1:]:
                    forest.join(int(same[0]), int(j))
        mark = np.zeros(len(everything), dtype=np.int64)
        for i in guests if paired else hosts:
            near = hosts if paired else hosts[hosts > i]
            # sizes alone rule out what cannot reach the threshold
            near = near[(den * np.minimum(sizes[near], sizes[i]) >= num * np.maximum(sizes[near], sizes[i])) & (sizes[near] > 0)]
            root = forest.find(i)
            near = np.array([j for j in near if forest.find(j) != root], dtype=np.int64)
            if not len(near) or not sizes[i]:
                continue
            mark[code[begin[i] : ends[i]]] = 1
            for at in range(0, len(near), 512):
                some = near[at : at + 512]
                taken = np.concatenate([code[begin[j] : ends[j]] for j in some])
                common = np.add.reduceat(mark[taken], np.cumsum(sizes[some]) - sizes[some])
                for j in some[den * common >= num * (sizes[some] + sizes[i] - common)]:
                    if forest.join(i, int(j)):
                        links.append((ids[i], ids[j]))
            mark[code[begin[i] : ends[i]]] = 0
        return pd.DataFrame({"u": np.array([a for a, _ in links], np.int64), "v": np.array([b for _, b in links], np.int64)})

    return run


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    threshold: tuple[int, int] = (4, 5),
) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of `docs`.

    Two documents are linked if their sets of `shingle`-word shingles have a
    Jaccard similarity of at least threshold[0] / threshold[1], checked on the
    full sets in integers; component_id is the least id reachable over links.

    Null or empty texts, and texts of white space, have no shingles and their
    own id as component.  Repeated rows are returned as often as they come.
    Rows that share an id with different texts link whatever either text links.
    A null id is returned with a null component and links nothing.  An empty
    table gives an empty result; texts of any length are taken whole, and
    other columns don't matter, whatever their names.
    """
    text_batches(docs.sparkSession)
    num, den = threshold
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketched = materialize(docs.mapInArrow(_sketch(shingle), "doc_id long, n long, print binary, regs binary"), "sketches")
    usable = sketched.where("n > 0 and doc_id is not null")
    classes = usable.groupBy("print").agg(F.min("doc_id").alias("rep"))
    held = usable.select("doc_id", "print").distinct().join(classes, "print").select("doc_id", "rep", "print")
    held = materialize(held, "classes")
    # one row for each class, under its least id (and its print, as an id may hold several texts)
    reps = held.where("doc_id = rep").join(usable, ["doc_id", "print"]).select(F.col("rep").alias("id"), "print", "n", "regs")
    reps = materialize(reps.dropDuplicates(["id", "print"]), "reps")

    bands = materialize(reps.select("id", "regs").mapInArrow(_bands, "band long, id long"), "bands")
    pivots = bands.groupBy("band").agg(F.min("id").alias("p"), F.max("id").alias("last")).where("p < last").drop("last")
    shared = materialize(bands.join(pivots, "band").where("id > p"), "shared")  # a pivot itself is compared with all
    stars = shared.select(F.col("id").alias("u"), F.col("p").alias("v")).distinct()
    least = max(num / den - SLACK, 0.0)
    paired = (
        stars.join(reps.select(F.col("id").alias("u"), "n", "regs"), "u")
        .join(reps.select(F.col("id").alias("v"), F.col("n").alias("pn"), F.col("regs").alias("pregs")), "v")
        .mapInArrow(_loose(least), "u long, v long")
    )
    families = materialize(connected_components(paired).withColumnRenamed("component", "family"), "families")
    bridges = materialize(_bridges(shared.select("band", "id"), families, reps, least), "bridges")
    discard(bands, shared)
    if bridges.limit(1).count():
        known = families.select(F.col("node").alias("u"), F.col("family").alias("v"))
        families = materialize(connected_components(known.unionByName(bridges)).withColumnRenamed("component", "family"), "families")

    weights = reps.groupBy(F.col("id").alias("node")).agg(F.sum("n").alias("n"))
    sizes = families.join(weights, "node").groupBy("family").agg(F.count("*").alias("members"), F.sum("n").alias("held"))
    members = families.join(sizes, "family").select(
        F.col("node").alias("id"),
        "family",
        F.ceil(F.greatest(F.col("members") / CHUNK, F.col("held") / CHUNK_SHINGLES)).cast("int").alias("chunks"),
        F.pmod(F.xxhash64("node", F.lit(1)), F.col("members")).alias("lot"),
    )
    members = members.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks").cast("long")).cast("int"))
    n_members = families.count()
    texts = semi_reduce(docs.withColumnRenamed("doc_id", "id"), families.select(F.col("node").alias("id")), "id", n_members)
    texts = materialize(members.join(texts.dropDuplicates(), "id").where("text is not null"), "members")
    verify = _verify(shingle, num, den)

    everywhere = (F.col("lot") < LANDMARKS) & (F.col("chunks") > 1)
    spread = F.when(everywhere, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("chunk"))
    inside = (
        texts.select("family", F.explode(spread).alias("chunk"), "id", "text", F.lit(1).alias("role"), F.lit(0).cast("long").alias("label"))
        .groupBy("family", "chunk")
        .applyInPandas(verify, "u long, v long")
    )
    links = materialize(inside, "links")
    found = materialize(connected_components(links), "found")

    # what did not join the main component of a family of several chunks
    large = texts.where("chunks > 1").select("id", "family", "chunks", "chunk", "text")
    large = large.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
    large = materialize(large, "large")
    if large.limit(1).count():
        votes = large.groupBy("family", "label").agg(F.count("*").alias("votes"))
        main = votes.groupBy("family").agg(F.max(F.struct("votes", F.col("label").alias("main")))["main"].alias("main"))
        large = large.join(main, "family")
        others = large.where("label <> main")
        lots = others.groupBy("family").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("lots"))
        guests = others.join(lots, "family").select(
            "family",
            F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
            F.pmod(F.xxhash64("id", F.lit(2)), F.col("lots").cast("long")).cast("int").alias("part"),
            "id", "text", F.lit(0).alias("role"), "label",
        )
        hosts = large.join(lots, "family").select(
            "family", "chunk", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("part"), "id", "text", F.lit(1).alias("role"), "label"
        )
        across = guests.unionByName(hosts).groupBy("family", "chunk", "part").applyInPandas(_guarded(verify), "u long, v long")
        links = materialize(links.unionByName(across), "links")
        found = materialize(connected_components(links), "found")

    discard(texts, families)
    # ids that hold several texts link their classes
    several = held.where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).distinct()
    if held.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").limit(1).count():
        found = connected_components(links.unionByName(several))
        own = found.select(F.col("node").alias("doc_id"), "component")
    else:
        own = held.select("doc_id", F.col("rep").alias("node")).join(found, "node", "left")
        own = own.select("doc_id", F.coalesce("component", "node").alias("component"))
    return sketched.select("doc_id", F.col("n").alias("n_shingles")).join(own, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )


def _guarded(verify):
    """Compare only where a chunk has guests: else its members are done."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if not (pdf["role"] == 0).any():
            return pd.DataFrame({"u": np.zeros(0, np.int64), "v": np.zeros(0, np.int64)})
        return verify(key, pdf)

    return run
