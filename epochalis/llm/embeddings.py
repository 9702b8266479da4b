"""Embedding near-duplicates by a pivot-permutation index.

A vector is described by its nearest reference points in order, PREFIX of PIVOTS
that are taken from a bounded sample. It is entered in the inverted list of each
pivot of its description, kept apart by label. Inside a list, two vectors are a
candidate if they share at least SHARED pivots, counted by a product of
membership matrices, and candidates are verified by the cosine in double
precision. A pair that meets in several lists is handled in the list of its
smallest shared pivot alone. Vectors with equal bytes are one entry with a
weight. Only counts and spanning links leave a task, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, group_starts, link_labels, materialise, read_table, shuffle_width, whole_groups

THRESHOLD = 0.98
PIVOTS, PREFIX, SHARED = 96, 8, 3
#: about how many rows pivots are drawn from (at most twice as many), chosen by a hash
SAMPLE = 4096
#: rows of one block of an inverted list; a longer list is cut into blocks, and each pair of blocks is a task of its own
BLOCK = 1024


def usable(vector) -> F.Column:
    """Not null, not empty, all components finite, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def pivots_of(entries: DataFrame, n: int, sample: int) -> dict[int, np.ndarray]:
    """Length -> pivots: the first of the sample, then always the sample vector farthest from those taken."""
    share = max(1, entries.count() // sample)
    rows = entries.where(F.pmod(F.xxhash64("vector"), F.lit(share)) == 0).select("rep", "vector").limit(2 * sample).collect()
    by_size: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: r["rep"]):
        by_size.setdefault(len(r["vector"]), []).append(r["vector"])
    out = {}
    for size, vectors in by_size.items():
        u = unit(np.array(vectors, float))
        chosen, near = [0], u @ u[0]
        while len(chosen) < min(n, len(u)):
            chosen.append(int(near.argmin()))
            near = np.maximum(near, u @ u[chosen[-1]])
        out[size] = u[chosen]
    return out


def described(entries: DataFrame, pivots: dict[int, np.ndarray], prefix: int) -> DataFrame:
    """``label, size, pivot, rep, weight, order array<int>, vector``: a row for each inverted list that a vector is in.

    Vectors of a length that the sample lacks share the list of pivot -1.
    """
    shared = entries.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(3)
            sizes = vectors.value_lengths().to_numpy()
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                part = batch.take(pa.array(at))
                u = unit(part.column(3).flatten().to_numpy().reshape(-1, size))
                known = shared.value.get(int(size))
                if known is None:
                    order = np.full((len(at), 1), -1)
                else:
                    order = np.argsort(-(u @ known.T), axis=1, kind="stable")[:, :prefix]
                k = order.shape[1]
                rows = pa.array(np.repeat(np.arange(len(at)), k))
                orders = pa.ListArray.from_arrays(pa.array(np.arange(0, len(at) * k + 1, k, dtype=np.int32)), pa.array(order.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), pa.array(np.full(len(rows), size, np.int32)), pa.array(order.ravel().astype(np.int32)), part.column(1).take(rows), part.column(2).take(rows), orders.take(rows), part.column(3).take(rows)], names)

    names = ["label", "size", "pivot", "rep", "weight", "order", "vector"]
    kind = entries.schema["label"].dataType.simpleString()
    return entries.select("label", "rep", "weight", "vector").mapInArrow(run, f"label {kind}, size int, pivot int, rep bigint, weight bigint, order array<int>, vector array<double>")


def list_links(pivot: int, mine: np.ndarray, theirs: np.ndarray | None, least: int, threshold: float, member: np.ndarray, vectors: np.ndarray):
    """Index pairs (a < b) that are linked and belong to this list.

    ``member``: rows by pivots, 0 or 1. Between two blocks only pairs across them;
    within a block (``theirs`` None) each pair once.
    """
    second = mine if theirs is None else theirs
    found = []
    u = unit(vectors)
    for lo in range(0, len(mine), 256):
        a = mine[lo : lo + 256]
        # candidates first, by what they share; only they are verified
        ok = np.ones((len(a), len(second)), bool) if pivot < 0 else member[a] @ member[second].T >= least
        if pivot > 0:
            ok &= member[a, :pivot] @ member[second, :pivot].T == 0
        if theirs is None:
            ok &= a[:, None] < second[None, :]
        if 8 * np.count_nonzero(ok) > ok.size:  # so many that one product of all is less work
            ok &= u[a] @ u[second].T >= threshold
            i, j = np.nonzero(ok)
        else:
            i, j = np.nonzero(ok)
            near = np.concatenate([np.einsum("ij,ij->i", u[a[i[k : k + 65536]]], u[second[j[k : k + 65536]]]) for k in range(0, len(i), 65536)] or [np.zeros(0)]) >= threshold
            i, j = i[near], j[near]
        found.append(np.column_stack((a[i], second[j])))
    return np.concatenate(found) if found else np.zeros((0, 2), int)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, n_pivots: int = PIVOTS, prefix: int = PREFIX, shared: int = SHARED, block: int = BLOCK) -> DataFrame:
    """``id_col, n_links, component_id, kept``, a row for each row of ``vectors``.

    Vectors are compared when their labels are equal and not null. A vector that
    is null, empty, zero, or holds null or non-finite components links with
    nothing, nor does one of another length. Equal vectors link with each other.
    Ids are integers and unique. Columns of other names don't matter.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.withColumn("ok", usable(F.col("vector")) & F.col("label").isNotNull())
    entries = materialise(rows.where("ok").groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count("*").alias("weight")), "pivot-entries")
    lists = described(entries, pivots_of(entries, n_pivots, SAMPLE), prefix)
    key = ["label", "size", "pivot"]
    lists = materialise(lists, "pivot-lists")
    sizes = lists.groupBy(key).agg(F.ceil(F.count("*") / block).cast("int").alias("nb"), F.count("*").alias("n")).where("n > 1").drop("n")
    dealt = (
        lists.join(sizes, key)
        .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .withColumn("i", F.least("own", "other"))
        .withColumn("j", F.greatest("own", "other"))
        .withColumn("task", F.xxhash64(*key, "i", "j"))
        .select("task", "pivot", "i", "j", "own", "rep", "weight", "order", "vector")
        .repartition(shuffle_width(spark), "task")
        .sortWithinPartitions("task")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["task"], 4096):
            task, pivot, own, rep, weight = (table.column(c).to_numpy() for c in ("task", "pivot", "own", "rep", "weight"))
            diagonal = table.column("i").to_numpy() == table.column("j").to_numpy()
            starts = group_starts(task)
            labels, more = np.arange(len(task)), np.zeros(len(task), np.int64)
            for lo, hi in zip(starts, [*starts[1:], len(task)]):
                if hi - lo < 2:
                    continue
                part = table.slice(lo, hi - lo)
                data = np.array(part.column("vector").to_pylist())
                orders = part.column("order").to_pylist()
                member = np.zeros((hi - lo, n_pivots), np.float32)
                if pivot[lo] >= 0:
                    member[np.repeat(np.arange(hi - lo), [len(o) for o in orders]), np.concatenate(orders)] = 1
                if diagonal[lo]:
                    mine, theirs = np.arange(hi - lo), None
                else:
                    mine, theirs = (np.flatnonzero(own[lo:hi] == b) for b in (own[lo:hi].min(), own[lo:hi].max()))
                    if own[lo:hi].min() == own[lo:hi].max():
                        continue
                pairs = list_links(int(pivot[lo]), mine, theirs, min(shared, len(orders[0])), threshold, member, data)
                a, b = pairs[:, 0] + lo, pairs[:, 1] + lo
                np.add.at(more, a, weight[b])
                np.add.at(more, b, weight[a])
                link_labels(labels, a, b)
            some = more > 0
            yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(rep[labels[some]]), pa.array(more[some])], ["a", "b", "n"])

    links = materialise(dealt.mapInArrow(run, "a bigint, b bigint, n bigint"), "pivot-links")
    partners = links.groupBy("a").agg(F.sum("n").alias("partners"))
    components = connected_components(links.select("a", "b"))
    found = entries.join(partners, entries.rep == partners.a, "left").join(components, entries.rep == components.id, "left").select("label", "vector", (F.coalesce("partners", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.where("ok").join(found, ["label", "vector"]).select("id", "n_links", "component_id")
    rest = rows.where("not ok").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    out = out.unionAll(rest)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op2_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))
