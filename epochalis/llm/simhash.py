"""SimHash near-duplicates with a Gray-ordered hierarchical Hamming index.

Fingerprints: Python workers over Arrow batches (XXH64 of word shingles, bit
majorities by numpy). Links: distinct fingerprints are dealt to shards by the
pigeonhole rule (with d allowed differences and d+1 bit blocks, two linked
fingerprints agree on one block), and each shard holds the hierarchical index:
rows in Gray rank, upper nodes that factor out the bits their rows agree on,
and a dual descent that drops a pair of nodes once their agreed bits already
differ too often. Nothing is approximate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, group_starts, link_labels, materialise, shuffle_width, whole_groups

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
FAN = 16
SHARD_CAP = 4096


def text_fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of one text; 0 if it has no words."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) < words:
        hashes = np.array([xxh64_intdigest(joined, seed)], np.uint64)
        return int(hashes[0])
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    a, b = starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(a), 1 << 15):
        hashes = np.array([xxh64_intdigest(joined[i:j], seed) for i, j in zip(a[lo : lo + (1 << 15)], b[lo : lo + (1 << 15)])], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(a), bitorder="little").view("<u8")[0])


def majority(hashes: np.ndarray) -> int:
    """64 bits, each set if it is in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[lo : lo + (1 << 15)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """``(id_col, fp)``: fp is the fingerprint's 64 bits as a signed long.

    A null or empty text has no words and gets 0; a text of fewer words than a
    shingle is one shingle; repeats count; texts are read whole, whatever their
    length. Other columns, of whatever name, are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([text_fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.int64())], [id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp bigint")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Position of each code word in the binary-reflected Gray sequence."""
    rank = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


def _children(parents_a, parents_b, first, last):
    """All child pairs of node pairs, with the half above the diagonal where a node meets itself."""
    na, nb = last[parents_a] - first[parents_a], last[parents_b] - first[parents_b]
    size = na * nb
    at = np.repeat(np.arange(len(size)), size)
    k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    a, b = first[parents_a][at] + k // nb[at], first[parents_b][at] + k % nb[at]
    keep = a <= b
    return a[keep], b[keep]


def hamming_classes(group: np.ndarray, fp: np.ndarray, most: int) -> np.ndarray:
    """Label of each row: the smallest row index reachable by links (<= ``most``
    differing bits) inside its group. Rows are sorted by group, then Gray rank."""
    n = len(fp)
    labels = np.arange(n)
    if n < 2:
        return labels
    # level 0: rows; each upper node holds up to FAN nodes of one group
    levels = [(fp, np.full(n, ~np.uint64(0)), None, None, group)]
    while True:
        pattern, mask, _, _, g = levels[-1]
        starts = group_starts(g)
        sizes = np.diff(np.append(starts, len(g)))
        if sizes.max() == 1 or len(levels) > 1 and sizes.max() <= FAN:
            break
        inside = np.arange(len(g)) - np.repeat(starts, sizes)
        first = np.flatnonzero(inside % FAN == 0)
        ones, zeros = np.bitwise_and.reduceat(pattern & mask, first), np.bitwise_and.reduceat(~pattern & mask, first)
        levels.append((ones, ones | zeros, first, np.append(first[1:], len(g)), g[first]))

    def near(level, a, b):
        pattern, mask = levels[level][:2]
        ok = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= most
        return a[ok], b[ok]

    def descend(level, a, b):
        a, b = near(level, a, b)
        if level == 0:
            keep = a != b
            link_labels(labels, a[keep], b[keep])
            return
        first, last = levels[level][2:4]
        for lo in range(0, len(a), 2048):
            descend(level - 1, *_children(a[lo : lo + 2048], b[lo : lo + 2048], first, last))

    top = len(levels) - 1
    starts = group_starts(levels[top][4])
    sizes = np.diff(np.append(starts, len(levels[top][4])))
    wide = sizes > (1 if top == 0 else 0)
    starts, sizes = starts[wide], sizes[wide]
    for lo in range(0, len(starts), 2048):
        roots = np.arange(len(starts))[lo : lo + 2048]
        descend(top, *_children(roots, roots, starts, starts + sizes))
    return labels


def hamming_links(points: DataFrame, most: int = 4, cap: int = SHARD_CAP) -> DataFrame:
    """``points(fp, rep)`` with distinct fp -> spanning links ``(a, b)`` between reps.

    Each shard returns at most one link a row, so a dense class of m fingerprints
    costs m links and not m*m. A shard over ``cap`` rows is cut into blocks and
    every pair of its blocks becomes a shard of its own, so no task holds more
    than about ``2*cap`` rows at once and none is dropped.
    """
    blocks = most + 1
    base, extra = divmod(64, blocks)
    widths = [base + (i < extra) for i in range(blocks)]
    offs = np.cumsum([0, *widths[:-1]]).tolist()
    keyed = points.select(
        "fp",
        "rep",
        F.inline(F.array(*[F.struct(F.lit(i).alias("k"), F.shiftrightunsigned("fp", o).bitwiseAND((1 << w) - 1).cast("int").alias("v")) for i, (o, w) in enumerate(zip(offs, widths, strict=True))])),
    )
    # at most blocks * 2**width rows, whatever the input: safe to broadcast
    sizes = keyed.groupBy("k", "v").agg(F.ceil(F.count("*") / cap).cast("int").alias("nb"), F.count("*").alias("size")).where("size > 1").drop("size")
    dealt = (
        keyed.join(F.broadcast(sizes), ["k", "v"])
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, nb - 1)")))
        .select("k", "v", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "rep")
        .withColumn("task", F.xxhash64("k", "v", "i", "j"))
        .select("task", "fp", "rep")
        .repartition(shuffle_width(points.sparkSession), "task")
        .sortWithinPartitions("task")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["task"], 1 << 16):
            task, fp, rep = (table.column(c).to_numpy() for c in ("task", "fp", "rep"))
            fp = fp.view(np.uint64)
            order = np.lexsort((gray_rank(fp), task))
            task, fp, rep = task[order], fp[order], rep[order]
            labels = hamming_classes(task, fp, most)
            moved = labels != np.arange(len(labels))
            yield pa.RecordBatch.from_arrays([pa.array(rep[moved]), pa.array(rep[labels[moved]])], ["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, most: int = 4) -> DataFrame:
    """``(id_col, fp, component_id)``: fingerprints link at ``most`` or fewer
    differing bits; component_id is the smallest id reachable, its own included.

    Ids are integers and unique. Texts without words share fingerprint 0 and are
    linked like any others. An empty table gives an empty result.
    """
    marks = materialise(fingerprints(docs, id_col, text_col, words).withColumnRenamed(id_col, "id"), "simhash")
    points = marks.groupBy("fp").agg(F.min("id").alias("rep"))
    points = materialise(points, "simhash-points")
    comp = connected_components(hamming_links(points, most))
    named = points.join(comp, points.rep == comp.id, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return marks.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def op7_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = near_duplicates(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 4, most: int = 4) -> DataFrame:
    """Keeps the document with the smallest id of each class of fingerprints at ``most`` or fewer differing bits; a row without an id stays."""
    kept = near_duplicates(docs, words=words, most=most).where("doc_id = component_id").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi").unionAll(docs.where("doc_id is null"))
