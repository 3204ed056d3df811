"""Streams of usage events and of incoming documents."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ranks import exact_ranks


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Read all input of a stream and return its result as a table at `path`."""

    def step(batch: DataFrame, batch_id: int) -> None:
        # a batch that is run again replaces itself; in complete mode the last one is the result
        part = path if mode == "complete" else f"{path}/batch={batch_id}"
        batch.write.mode("overwrite").parquet(part)

    job = stream.writeStream.foreachBatch(step).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    job.awaitTermination()
    rows = stream.sparkSession.read.schema(stream.schema)
    return rows.parquet(path) if mode == "complete" else rows.option("recursiveFileLookup", True).parquet(path)


def usage_windows(events: DataFrame, width: str = "1 day", late: str = "1 day", keys: tuple[str, ...] = ("subject",)) -> DataFrame:
    """Counts of events (ts, keys) in event-time windows; late ones within `late` count."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = rows.groupBy(F.window("ts", width).alias("w"), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), *keys, "n")


def quota(requests: DataFrame, limit: int) -> DataFrame:
    """Lifetime quota of a stream of (subject, request_id, cost): accepted or not.

    The state of a subject is what it has used; a rejected request costs
    nothing.  Costs may vary, so this is a fold and not a count: in one trigger
    a subject's requests are taken in the order of their ids, whatever batches
    they come in (three numbers of each are held until then).
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0
        rows = pd.concat([pdf[["request_id", "cost"]] for pdf in batches]).sort_values("request_id")
        accepted, after = [], []
        for cost in rows["cost"].tolist():
            fits = used + cost <= limit
            used += cost if fits else 0
            accepted.append(fits)
            after.append(used)
        state.update((used,))
        yield pd.DataFrame({"subject": key[0], "request_id": rows["request_id"].to_numpy(), "accepted": accepted, "used": after})

    schema = "subject string, request_id long, accepted boolean, used long"
    return requests.groupBy("subject").applyInPandasWithState(run, schema, "used long", "append", GroupStateTimeout.NoTimeout)


def once(documents: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """A stream of documents (ts, keys) without what was seen within `late`."""
    return documents.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table written run by run, with its columns `poll` and `run`; empty before the first."""
    schema = f"{schema}, poll string, run string"
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


class PollIngest:
    """Appends new documents to a table, at most so many a poll, and loses none.

    `path` holds three tables, each with a folder for every run of one poll or
    more that a run of the same name replaces: `waiting` has all documents of
    more than `least_bytes` that were seen, `documents` those that were taken,
    `log` a row for each poll.  A poll takes, of what waits and whose `keys` no
    other poll has taken, the `most` documents of the least ids; of those with
    equal keys the one of the least id.  The others stay and are taken by later
    polls.  Rows without an id are never taken.
    """

    def __init__(self, path: str, schema: str, keys: list[str], most: int = 3, least_bytes: int = 5000):
        self.path, self.schema, self.keys, self.most, self.least_bytes = path, schema, keys, most, least_bytes

    def documents(self, spark: SparkSession) -> DataFrame:
        return _table(spark, f"{self.path}/documents", self.schema).drop("run")

    def log(self, spark: SparkSession) -> DataFrame:
        return _table(spark, f"{self.path}/log", "status string, found long, new long").drop("run")

    def _waiting(self, spark: SparkSession) -> DataFrame:
        rows = _table(spark, f"{self.path}/waiting", f"{self.schema}, _long boolean").where("_long and id is not null")
        return rows.drop("_long", "poll", "run").withColumn("_of", F.struct("id", *self.keys))

    def _fresh(self, spark: SparkSession, run: str) -> DataFrame:
        """(keys, id): for all keys that wait and that no other run has taken, the least id."""
        waiting = self._waiting(spark)
        taken = _table(spark, f"{self.path}/documents", self.schema).where(F.col("run") != run).select(*self.keys)
        same = functools.reduce(lambda a, b: a & b, (waiting[k].eqNullSafe(taken[k]) for k in self.keys))
        return waiting.join(taken, same, "left_anti").groupBy(*self.keys).agg(F.min("id").alias("id"))

    def _take(self, spark: SparkSession, run: str, chosen: DataFrame) -> DataFrame:
        """Write the documents of `chosen` (_of, poll) as those of a run; (poll, new) of its polls."""
        part = f"{self.path}/documents/run={run}"
        rows = self._waiting(spark).join(chosen, "_of").dropDuplicates(["_of"]).drop("_of")
        rows.write.mode("overwrite").parquet(part)
        return spark.read.schema(f"{self.schema}, poll string").parquet(part).groupBy("poll").agg(F.count("*").alias("new"))

    def poll(self, spark: SparkSession, poll: str, arrived: DataFrame | None = None) -> int:
        """One poll, with new documents or without; the number of those taken."""
        found = 0
        if arrived is not None:
            seen = f"{self.path}/waiting/run={poll}"
            arrived.withColumn("_long", F.length("text") > self.least_bytes).write.mode("overwrite").parquet(seen)
            found = spark.read.parquet(seen).count()
        first = self._fresh(spark, poll).orderBy("id", *self.keys).limit(self.most)  # ids of so many rows at most
        taken = self._take(spark, poll, F.broadcast(first.select(F.struct("id", *self.keys).alias("_of"), F.lit(poll).alias("poll")))).first()
        new = taken["new"] if taken else 0
        row = [("success" if new else "no_changes", found, new, poll)]
        spark.createDataFrame(row, "status string, found long, new long, poll string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/run={poll}")
        return new

    def stream(self, incoming: DataFrame, checkpoint: str):
        """A poll for each batch of a stream, until all input is read."""
        step = lambda batch, batch_id: self.poll(batch.sparkSession, f"s{batch_id:09d}", batch) and None
        return incoming.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def drain(self, spark: SparkSession) -> int:
        """Polls without new documents until nothing waits; their number.

        Nothing arrives between these polls, so each takes the next ids after
        those of the one before: places in one order name the poll of every
        document that waits, and all polls are one run over the tables.
        """
        done = self.log(spark).where("poll like 'd%'").count()
        run, name = f"d{done:09d}", lambda nth: F.format_string("d%09d", nth)
        ranked = exact_ranks(self._fresh(spark, run), [], ["id", *self.keys])
        nth = F.floor((F.col("rank") - 1) / self.most).cast("long")
        new = self._take(spark, run, ranked.select(F.struct("id", *self.keys).alias("_of"), name(nth + done).alias("poll")))
        polls = new.count()
        last = spark.range(1).select(F.lit("no_changes").alias("status"), F.lit(0).cast("long").alias("found"), F.lit(0).cast("long").alias("new"), name(F.lit(done + polls)).alias("poll"))
        log = new.select(F.lit("success").alias("status"), F.lit(0).cast("long").alias("found"), "new", "poll").unionByName(last)
        log.write.mode("overwrite").parquet(f"{self.path}/log/run={run}")
        return polls


def ingest(incoming: DataFrame, path: str, checkpoint: str, keys: list[str], most: int = 3, least_bytes: int = 5000):
    """Poll once for each batch of `incoming` (id, text, keys): see PollIngest."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in incoming.schema)
    return PollIngest(path, schema, keys, most, least_bytes).stream(incoming, checkpoint)


def credit_windows(requests: DataFrame, limit: int, hours: int = 24, late: str = "1 day") -> DataFrame:
    """A stream of requests (subject, request_id, ts, cost), each accepted or not.

    A subject's window begins with its first request and lasts `hours`; the
    next request after that begins another.  A request is accepted if its cost
    fits into what is left of `limit`; a rejected one costs nothing.  Requests
    of one trigger are taken in order of time and id; those later than `late`
    are dropped.  State is one pair of numbers for each subject with an open
    window: it is removed when the watermark passes the window's end.  State
    travels with the rows of many subjects at once, not by calls for each of
    them.  `used` is what the window has used after a request, `since` its
    beginning.
    """
    width = hours * 3_600_000_000

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # the watermark has passed the end of the window: an idle subject keeps no state
            state.remove()
            return
        start, used = state.get if state.exists else (None, 0)
        parts = [[pdf[c].to_numpy() for c in ("micros", "request_id", "cost")] for pdf in batches]
        micros, ids, costs = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((ids, micros))
        micros, ids, costs = micros[order], ids[order], costs[order]
        accepted, after, begins = [], [], []
        for at, cost in zip(micros.tolist(), costs.tolist()):
            if start is None or at >= start + width:
                start, used = at, 0
            fits = used + cost <= limit
            used += cost if fits else 0
            accepted.append(fits)
            after.append(used)
            begins.append(start)
        state.update((start, used))
        state.setTimeoutTimestamp((start + width) // 1000 + 1)
        yield pd.DataFrame({"subject": key[0], "request_id": ids, "cost": costs, "accepted": accepted, "used": after, "since": begins})

    rows = requests.withColumn("micros", F.unix_micros("ts")).withWatermark("ts", late)
    schema = "subject string, request_id long, cost long, accepted boolean, used long, since long"
    out = rows.groupBy("subject").applyInPandasWithState(run, schema, "start long, used long", "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumn("since", F.timestamp_micros("since"))


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that are started within keep their state in RocksDB, outside the heap."""
    key, kind = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key)
    spark.conf.set(key, kind)
    try:
        yield
    finally:
        spark.conf.set(key, before)
