"""EDF recordings as a Spark data source: files are cut into ranges of records, channels and times are pruned at the source.

``spark.read.format("edf").option("channels", "Fz,Cz").option("from_s", 60).load(path)``
gives ``path, channel, fs, start, values, error``: a row a channel and stretch of
records. Only headers are read to plan; a task reads the bytes of its records. A
file that can't be read is one row with ``error``, its other columns null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as store
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, channel string, fs double, start bigint, values array<double>, error string"
#: samples of a channel in one row, and bytes of a file in one task, at most (one record at least)
ROW_SAMPLES, TASK_BYTES = 1 << 14, 32 << 20


@dataclass(frozen=True)
class Header:
    """What is needed to find a channel's samples: fixed-width text fields of 256 bytes and 256 more a signal."""

    labels: tuple
    sizes: tuple
    gains: tuple
    offsets: tuple
    seconds: float
    n_records: int
    body: int
    start_s: int | None

    @staticmethod
    def parse(head: bytes, file_size: int) -> Header:
        """Raises ValueError for what isn't a header. The number of records is held to those that are there whole."""
        text = lambda a, b: head[a:b].decode("latin-1").strip()
        if len(head) < 256:
            raise ValueError("shorter than a header")
        ns, seconds = int(text(252, 256)), float(text(244, 252))
        if ns < 1 or not 0 < seconds < float("inf"):
            raise ValueError("no signals or no record length")
        if len(head) < 256 * (ns + 1):
            raise ValueError("shorter than its header says")
        ends = np.cumsum([0, 16, 80, 8, 8, 8, 8, 8, 80, 8]) * ns + 256
        column = lambda k: [text(ends[k] + i * w, ends[k] + (i + 1) * w) for w in [(ends[k + 1] - ends[k]) // ns] for i in range(ns)]
        low, high, dlow, dhigh = (np.array([float(x) for x in column(k)]) for k in (3, 4, 5, 6))
        sizes = [int(x) for x in column(8)]
        if min(sizes) < 0 or sum(sizes) < 1:
            raise ValueError("no samples in a record")
        gain = (high - low) / np.where(dhigh == dlow, 1, dhigh - dlow)
        whole = (file_size - 256 * (ns + 1)) // (2 * sum(sizes))
        told = int(text(236, 244))
        clock = [p for p in text(168, 176).replace(":", ".").split(".") if p.isdigit()]
        start = int(clock[0]) * 3600 + int(clock[1]) * 60 + int(clock[2]) if len(clock) > 2 else None
        return Header(tuple(column(0)), tuple(sizes), tuple(gain), tuple(low - gain * dlow), seconds, max(0, min(told if told > 0 else whole, whole)), 256 * (ns + 1), start)


def opened(path: str) -> tuple[store.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return store.FileSystem.from_uri(path) if "://" in path else (store.LocalFileSystem(), path.removeprefix("file:"))


def listed(path: str, ending: str) -> list[tuple[str, int]]:
    """Files below a folder, or the file itself, with their sizes, by name."""
    system, at = opened(path)
    info = system.get_file_info(at)
    if info.type == store.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else system.get_file_info(store.FileSelector(at, recursive=True))
    head = path[: len(path) - len(at)] if path.endswith(at) else ""
    return sorted((head + f.path, f.size) for f in found if f.is_file and f.path.lower().endswith(ending))


def read_header(path: str, size: int) -> Header:
    system, at = opened(path)
    with system.open_input_file(at) as f:
        head = f.read_at(min(256, size), 0)
        ns = head[252:256].decode("latin-1").strip()
        return Header.parse(head + f.read_at(min(256 * int(ns), max(0, size - 256)), 256) if ns.isdigit() else head, size)


@dataclass
class Records(InputPartition):
    """Records ``first`` to ``last`` of a file, or why it can't be read."""

    path: str
    first: int = 0
    last: int = 0
    header: Header | None = None
    error: str | None = None


class EdfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.channels = {c.strip() for c in options.get("channels", "").split(",")} - {""}
        self.from_s, self.until_s = float(options.get("from_s", 0)), float(options.get("until_s", "inf"))
        self.task_bytes = int(options.get("task_bytes", TASK_BYTES))

    def _parts(self, file: tuple[str, int]) -> list[Records]:
        path, size = file
        try:
            head = read_header(path, size)
        except (ValueError, OverflowError, OSError) as why:
            return [Records(path, error=f"{type(why).__name__}: {why}")]
        first = max(0, int(self.from_s // head.seconds))
        last = head.n_records if self.until_s == float("inf") else min(head.n_records, int(-(-self.until_s // head.seconds)))
        if not head.n_records:
            return [Records(path, error="no whole record")]
        # ranges begin at multiples of a row's records, so that rows stand alike whatever is pruned
        row = row_records(head)
        step = max(1, self.task_bytes // (2 * sum(head.sizes)) // row) * row
        return [Records(path, k, min(k + step, last), head) for k in range(first - first % row, last, step)]

    def partitions(self) -> list[Records]:
        with ThreadPoolExecutor(16) as pool:
            return [p for parts in pool.map(self._parts, listed(self.path, ".edf")) for p in parts]

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        names = ["path", "channel", "fs", "start", "values", "error"]
        batch = lambda *c: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(c, (pa.string(), pa.string(), pa.float64(), pa.int64(), pa.list_(pa.float64()), pa.string()))], names)
        head = partition.header
        if head is None:
            yield batch(partition.path, None, None, None, None, partition.error)
            return
        width, ends, row = sum(head.sizes), np.cumsum(head.sizes), row_records(head)
        system, at = opened(partition.path)
        with system.open_input_file(at) as f:
            for first in range(partition.first, partition.last, row):
                n = min(row, partition.last - first)
                raw = np.frombuffer(f.read_at(2 * width * n, head.body + 2 * width * first), "<i2").reshape(-1, width)
                for label, size, end, gain, offset in zip(head.labels, head.sizes, ends, head.gains, head.offsets):
                    if size and not label.startswith("EDF Annotations") and (not self.channels or label in self.channels):
                        yield batch(partition.path, label, size / head.seconds, first * size, raw[:, end - size : end].ravel() * gain + offset, None)


def row_records(head: Header) -> int:
    """Records in one row: no channel has more than ROW_SAMPLES samples there, if a record hasn't."""
    return max(1, ROW_SAMPLES // max(head.sizes))


class EdfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "edf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> EdfReader:
        return EdfReader(self.options)


def load_edf(spark: SparkSession, path: str, channels=(), from_s: float | None = None, until_s: float | None = None, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Rows of all EDF files below ``path``; records from ``from_s`` to ``until_s`` alone, channels with these labels alone, if given."""
    spark.dataSource.register(EdfSource)
    told = {"channels": ",".join(channels), "task_bytes": task_bytes, "from_s": from_s, "until_s": until_s}
    return spark.read.format("edf").options(**{k: v for k, v in told.items() if v not in (None, "")}).load(path)


def file_digests(spark: SparkSession, path: str, ending: str = ".edf", block: int = 1 << 22) -> DataFrame:
    """``path, sha256`` of all files below ``path``, each streamed by one task, a block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, at = opened(name)
                digest = hashlib.sha256()
                with system.open_input_stream(at) as f:
                    while data := f.read(block):
                        digest.update(data)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([digest.hexdigest()])], ["path", "sha256"])

    names = spark.createDataFrame([(p,) for p, _ in listed(path, ending)], "path string")
    return names.repartition(max(1, spark.sparkContext.defaultParallelism)).mapInArrow(run, "path string, sha256 string")
