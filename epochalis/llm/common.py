"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """Folder shared by all executors, from ``spark.checkpoint.dir``.

    A private folder is chosen only in local mode where the session names none (tests).
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="epochalis-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and
    a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``materialise`` wrote, when all that reads them is written itself."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.scratch)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


MAP_WORDS = 1 << 18


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def parted(docs: DataFrame, ids: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """``docs`` in two: those that may be among ``ids(id)``, and those that are surely not.

    Ids are marked in a map of ``64 * MAP_WORDS`` bits, which is all that is broadcast, whatever their number.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(64 * MAP_WORDS))
    bits = ids.select(place(F.col("id").cast("bigint")).alias("p")).select(F.shiftright("p", 6).alias("_word"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bit")).groupBy("_word").agg(F.bit_or("bit").alias("_bits"))
    bits = materialise(bits, "id-map")
    at = place(F.col(id_col).cast("bigint"))
    p, w, b = free_names(docs, "_place", "_word", "_bits")
    bits = bits.select(F.col("_word").alias(w), F.col("_bits").alias(b))
    held = docs.withColumn(p, at).withColumn(w, F.shiftright(p, 6)).join(F.broadcast(bits), w, "left")
    marked = F.coalesce(F.expr(f"shiftrightunsigned({b}, cast({p} & 63 as int)) & 1"), F.lit(0)) == 1
    return held.where(marked).select(docs.columns), held.where(~marked).select(docs.columns)


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``edges(a, b)`` longs -> ``(id, component)``; component is the smallest id
    reachable. Every id that has an edge to another id is returned.

    Alternating star contraction: each round is min-aggregations and equi-joins,
    so a vertex of any degree is pre-aggregated on the map side and skewed join
    sides are left to adaptive execution. Rounds grow with the logarithm of the
    component size.
    """
    cur = materialise(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "cc",
    )
    before = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of u is linked to u's smallest neighbour
        sym = cur.select("u", "v").unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            sym.join(low, "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        # small star: u and its smaller neighbours are linked to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))))
            .where("u <> v")
            .distinct()
        )
        old, cur = cur, materialise(small, "cc")
        discard(old)
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    tops = cur.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return cur.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(tops)


def link_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the classes of ``a`` and ``b`` (index pairs); the smallest index names a class."""
    while len(a):
        la, lb = labels[a], labels[b]
        open_ = la != lb
        if not open_.any():
            break
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up
    return labels


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Batches sorted by ``keys`` -> tables of about ``rows`` rows that never end inside a group."""
    held: list[pa.Table] = []
    n = 0

    def cut(table: pa.Table) -> int:
        last = [table.column(k)[-1].as_py() for k in keys]
        same = np.ones(table.num_rows, bool)
        for k, v in zip(keys, last, strict=True):
            same &= table.column(k).to_numpy() == v
        return int(np.argmax(same))

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        n += batch.num_rows
        if n >= rows:
            table = pa.concat_tables(held).combine_chunks()
            at = cut(table)
            if at:
                yield table.slice(0, at)
                table = table.slice(at)
            held, n = [table], table.num_rows
            rows = max(rows, 2 * n)
    if held:
        yield pa.concat_tables(held).combine_chunks()


def group_starts(*columns: np.ndarray) -> np.ndarray:
    """First row of each run of equal keys in sorted columns."""
    n = len(columns[0])
    change = np.zeros(n, bool)
    change[:1] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(MULTIPLIER, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i < n, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        _powers[base] = have = np.multiply.accumulate(out)
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of a hash (in place)."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Running polynomial hash; ``run_hash`` takes the hash of any run from it."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * powers(MULTIPLIER, len(values)), out=out[1:])
    return out


def run_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of ``values[start:end]``, the same wherever the run stands."""
    return mixed((prefix[end] - prefix[start]) * powers(_INVERSE, len(prefix))[start])


def text_slices(column: pa.Array, size: int) -> Iterator[tuple[int, list[bytes]]]:
    """``(first row, UTF-8 texts)`` of consecutive rows of about ``size`` bytes; null is empty."""
    held, n, first = [], 0, 0
    for row, value in enumerate(column):
        raw = value.as_buffer().to_pybytes() if value.is_valid else b""
        held.append(raw)
        n += len(raw) + 1
        if n >= size:
            yield first, held
            held, n, first = [], 0, row + 1
    if held:
        yield first, held
