"""A store of segments: every write adds files for its own documents alone.

A write takes the next number, writes a segment of each table and the ids of
the documents that it replaces or deletes (tombstones), and last a commit that
makes all of it visible at once.  Readers merge the committed segments: a row
is alive if no later tombstone names its document.  Compaction rewrites the
live rows of several segments as one, with the number of the write that each
row came from, so that writes that run meanwhile still reach them.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.profiles import Profile
from ..operators import lexical

TABLES = ("documents", "chunks", "postings")
TOMBSTONES = "document_id long, kind string, _seg long"
#: Tombstones (two numbers each, some 50 MB as a hash table) up to which they go to the rows; beyond it rows are shuffled.
MAX_BROADCAST_DEAD = 1_000_000


class SegmentStore:
    """Documents (document_id, ...), chunks (id, document_id, text, ...) and the postings of the chunks below `path`.

    `schemas` are those of the given tables; postings are (document_id, id, term, tf).
    """

    def __init__(self, spark: SparkSession, path: str, profile: Profile, schemas: dict[str, str]):
        self.spark, self.path, self.profile = spark, path.rstrip("/"), profile
        self.schemas = schemas | {"postings": "document_id long, id long, term string, tf long"}

    # -- commits -------------------------------------------------------------

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _names(self, folder: str) -> list[str]:
        store, at = self._fs(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in store.listStatus(at)) if store.exists(at) else []

    def _take(self, folder: str, name: str, text: str = "") -> bool:
        """Create a small file; False if it is there."""
        store, at = self._fs(f"{self.path}/{folder}/{name}")
        try:
            out = store.create(at, False)
        except Exception as error:
            if "already exists" not in str(error):
                raise
            return False
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _claim(self) -> int:
        """A number that no other writer has."""
        number = 1 + max((int(n) for n in self._names("claims") if n.isdigit()), default=0)
        while not self._take("claims", f"{number:012d}"):
            number += 1
        return number

    def _commit(self, number: int, tables: list[str], replaces: list[int] = ()) -> None:
        if not self._take("commits", f"{number:012d}", json.dumps({"seg": number, "tables": tables, "replaces": list(replaces)})):
            raise RuntimeError(f"segment {number} is committed already")

    def _commits(self) -> list[dict]:
        """One small record for each write since the last compaction, and those before."""
        if not self._names("commits"):
            return []
        rows = self.spark.read.schema("seg long, tables array<string>, replaces array<long>").json(f"{self.path}/commits").collect()
        return [r.asDict() for r in sorted(rows)]

    def live(self) -> list[dict]:
        commits = self._commits()
        gone = {n for c in commits for n in c["replaces"]}
        return [c for c in commits if c["seg"] not in gone]

    def _part(self, table: str, number: int) -> str:
        return f"{self.path}/{table}/seg-{number:012d}"

    def _write(self, number: int, tables: dict[str, DataFrame]) -> list[str]:
        for name, rows in tables.items():
            rows = rows if "_seg" in rows.columns else rows.withColumn("_seg", F.lit(number).cast("long"))
            rows.write.mode("overwrite").option("compression", "zstd").parquet(self._part(name, number))
        return list(tables)

    def _read(self, table: str, commits: list[dict], schema: str) -> DataFrame:
        paths = [self._part(table, c["seg"]) for c in commits if table in c["tables"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _postings(self, chunks: DataFrame) -> DataFrame:
        counted = lexical.row_counts(chunks, self.profile, keep=("document_id",))
        return counted.select("document_id", F.col("id").cast("long").alias("id"), "term", "tf")

    # -- writes --------------------------------------------------------------

    def insert(self, documents: DataFrame, chunks: DataFrame) -> int:
        number = self._claim()
        tables = self._write(number, {"chunks": chunks, "postings": self._postings(chunks), "documents": documents})
        self._commit(number, tables)
        return number

    def reindex(self, chunks: DataFrame) -> int:
        """Replace the chunks of the documents of `chunks`; no other document's files are touched."""
        number = self._claim()
        dead = chunks.select("document_id").distinct().select("document_id", F.lit("index").alias("kind"))
        tables = self._write(number, {"chunks": chunks, "postings": self._postings(chunks), "tombstones": dead})
        self._commit(number, tables)
        return number

    def delete(self, ids: DataFrame) -> int:
        """Delete documents (document_id) from all tables."""
        number = self._claim()
        dead = ids.select("document_id").distinct().select("document_id", F.lit("all").alias("kind"))
        self._commit(number, self._write(number, {"tombstones": dead}))
        return number

    def compact(self) -> int:
        """Rewrite all committed segments as one; their files stay for readers that have begun, `vacuum` deletes them."""
        commits = self.live()
        number = self._claim()
        tables = {name: self._alive(name, commits) for name in TABLES}
        tables["tombstones"] = self._read("tombstones", commits, TOMBSTONES).groupBy("document_id", "kind").agg(F.max("_seg").alias("_seg"))
        self._commit(number, self._write(number, tables), [c["seg"] for c in commits])
        return number

    def vacuum(self) -> None:
        """Delete the files of segments that a compaction has replaced."""
        live = {c["seg"] for c in self.live()}
        for commit in self._commits():
            for name in commit["tables"] if commit["seg"] not in live else ():
                store, at = self._fs(self._part(name, commit["seg"]))
                store.delete(at, True)

    # -- reads ---------------------------------------------------------------

    def _alive(self, name: str, commits: list[dict]) -> DataFrame:
        rows = self._read(name, commits, f"{self.schemas[name]}, _seg long")
        dead = self._read("tombstones", commits, TOMBSTONES)
        dead = dead.where("kind = 'all'") if name == "documents" else dead
        last = lexical.small(dead.groupBy("document_id").agg(F.max("_seg").alias("_dead")), MAX_BROADCAST_DEAD)
        return rows.join(last, "document_id", "left").where("_dead is null or _seg >= _dead").select(*rows.columns)

    def table(self, name: str) -> DataFrame:
        """The live rows of a table as of the last commit."""
        return self._alive(name, self.live()).drop("_seg")
