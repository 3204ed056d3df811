"""A Spark data source for legacy vector files (`format("snv1")`).

A file has a magic, the dimension and number of its vectors, their scales and
their codes.  Each task of a write makes files of a bounded number of vectors,
each with the ids beside it; a commit lists the files, so those of failed
attempts are never read.  A reader has a partition for each file.
"""

from __future__ import annotations

import json
import struct
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds

MAGIC = b"SNV1"
SCHEMA = "id long, scale float, q array<tinyint>"
LIST = "files.json"


def encode(scales: np.ndarray, codes: np.ndarray) -> bytes:
    """Codes are rows of int8."""
    return MAGIC + struct.pack("<II", codes.shape[1], len(codes)) + scales.astype("<f4").tobytes() + codes.astype(np.int8).tobytes()


def decode(content: bytes, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(scales, codes); a wrong magic, number or length is an error."""
    if len(content) < 12 or content[:4] != MAGIC:
        raise ValueError("not a vector file")
    dim, held = struct.unpack("<II", content[4:12])
    if held != count or len(content) != 12 + count * (4 + dim):
        raise ValueError("a vector file of another length")
    return np.frombuffer(content, "<f4", count, 12), np.frombuffer(content, np.int8, count * dim, 12 + 4 * count).reshape(count, dim)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class VectorFile(ds.InputPartition):
    name: str


class VectorReader(ds.DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        store, root = _opened(self.path)
        with store.open_input_file(f"{root}/{LIST}") as file:
            return [VectorFile(name) for name in json.loads(file.read())] or [VectorFile("")]

    def read(self, partition: VectorFile) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        store, root = _opened(self.path)
        parts = []
        for suffix in ("snv1", "ids"):
            with store.open_input_file(f"{root}/{partition.name}.{suffix}") as file:
                parts.append(file.read())
        ids = np.frombuffer(parts[1], "<i8")
        scales, codes = decode(parts[0], len(ids))
        lists = pa.ListArray.from_arrays(np.arange(len(ids) + 1, dtype=np.int32) * codes.shape[1], pa.array(codes.reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(scales), lists], names=["id", "scale", "q"])


@dataclass
class Files(ds.WriterCommitMessage):
    names: list[str]


class VectorWriter(ds.DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, rows: int):
        self.path, self.overwrite, self.rows = path, overwrite, rows

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Files:
        store, root = _opened(self.path)
        store.create_dir(root, recursive=True)
        names: list[str] = []
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

        def flush(width: int) -> None:
            ids, scales, codes = (np.concatenate(x) for x in zip(*held.pop(width)))
            name = f"part-{TaskContext.get().partitionId():05d}-{len(names):05d}-{uuid.uuid4().hex}"
            for suffix, content in (("snv1", encode(scales, codes)), ("ids", ids.astype("<i8").tobytes())):
                with store.open_output_stream(f"{root}/{name}.{suffix}", compression=None) as file:
                    file.write(content)
            names.append(name)

        for batch in iterator:
            lengths = batch.column("q").value_lengths().to_numpy(zero_copy_only=False)
            for width in np.unique(lengths).tolist():
                every = np.flatnonzero(lengths == width)
                for at in range(0, len(every), self.rows):
                    some = batch.take(pa.array(every[at : at + self.rows]))
                    codes = some.column("q").flatten().to_numpy(zero_copy_only=False).astype(np.int8).reshape(len(some), int(width))
                    held.setdefault(width, []).append((some.column("id").to_numpy(zero_copy_only=False), some.column("scale").to_numpy(zero_copy_only=False), codes))
                    if sum(len(x[0]) for x in held[width]) >= self.rows:
                        flush(width)
        for width in list(held):
            flush(width)
        return Files(names)

    def commit(self, messages) -> None:
        store, root = _opened(self.path)
        store.create_dir(root, recursive=True)
        names = [n for m in messages if m is not None for n in m.names]
        at = f"{root}/{LIST}"
        if not self.overwrite and store.get_file_info(at).type == fs.FileType.File:
            with store.open_input_file(at) as file:
                names = json.loads(file.read()) + names
        with store.open_output_stream(f"{at}.new", compression=None) as file:
            file.write(json.dumps(names).encode())
        store.move(f"{at}.new", at)

    def abort(self, messages) -> None:
        store, root = _opened(self.path)
        for name in (n for m in messages if m is not None for n in m.names):
            for suffix in ("snv1", "ids"):
                store.delete_file(f"{root}/{name}.{suffix}")


class VectorSource(ds.DataSource):
    """Options: path; rows of a file at most (4096)."""

    @classmethod
    def name(cls) -> str:
        return "snv1"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> VectorReader:
        return VectorReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> VectorWriter:
        return VectorWriter(self.options["path"], overwrite, int(self.options.get("rows", 4096)))


def register(spark: SparkSession) -> None:
    """Make `format("snv1")` known to the session."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(VectorSource)
