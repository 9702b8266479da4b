"""Exact deduplication by distributed MSD radix partitioning.

Texts are split by successive bytes, a digit of several bytes at a time, until a
group is one text or its texts have ended; equality is that of bytes, and no
digest decides anything. A batch's equal texts are found by the same splitting
before anything is shuffled, so that a text which a third of all rows hold goes
on as one row a batch. Across batches the first digit of each text is counted:
texts alone with theirs are done, groups that fit a task are finished there, and
larger ones are split by the next, four times longer digit. Only texts that share
their first digit with another one move, and those of groups too large for a task
stay where they are until a digit has parted them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, parted, read_table, shuffle_width, text_slices, whole_groups

#: bytes of the first digit, and how much longer each next one is
DIGIT, LONGER = 64, 4
#: a group of at most so many texts and bytes is finished in one task
GROUP_ROWS, GROUP_BYTES = 256, 4 << 20
#: bytes of text that are compared at once before the shuffle
LOCAL_BYTES = 32 << 20
_SPACES = b" \t\n\x0b\x0c\r"


def normalised(raw: bytes) -> bytes:
    """Each run of ASCII white space becomes one space."""
    inner = b" ".join(raw.split())
    if not inner:
        return b" " if raw else b""
    return b" " * (raw[0] in _SPACES) + inner + b" " * (raw[-1] in _SPACES)


def radix_classes(texts: list[bytes]) -> list[int]:
    """For each text the place of the first one that equals it, by splitting on successive bytes."""
    first = list(range(len(texts)))
    open_ = [(0, DIGIT, first[:])]
    while open_:
        at, width, rows = open_.pop()
        split: dict[bytes, list[int]] = {}
        for row in rows:
            split.setdefault(texts[row][at : at + width], []).append(row)
        for digit, part in split.items():
            if len(part) > 1 and len(digit) < width:  # ended
                for row in part:
                    first[row] = part[0]
            elif len(part) > 1:
                open_.append((at + width, width * LONGER, part))
    return first


def _local(docs: DataFrame, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    """Rows with their number, their batch's class (its first row, size and row that would stay) and, on that first row alone, the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo, raw in text_slices(batch.column(1), LOCAL_BYTES):
                texts = [normalised(t) for t in raw]
                first, ids = radix_classes(texts), batch.column(0).slice(lo, len(raw)).to_pylist()
                size: dict[int, int] = {}
                stays: dict[int, tuple] = {}
                for row, rep in enumerate(first):
                    size[rep] = size.get(rep, 0) + 1
                    key = (ids[row] is None, ids[row], row)
                    stays[rep] = min(stays.get(rep, key), key)
                digest = {rep: hashlib.sha256(texts[rep]).hexdigest() for rep in size}
                keep = [stays[rep][2] for rep in first]
                columns = [
                    batch.column(0).slice(lo, len(raw)), pa.array(range(at, at + len(raw)), pa.int64()), pa.array([at + r for r in first], pa.int64()), pa.array([size[r] for r in first], pa.int64()), pa.array([at + k for k in keep], pa.int64()),
                    batch.column(0).slice(lo, len(raw)).take(pa.array(keep, pa.int64())), pa.array([digest[r] for r in first], pa.string()), pa.array([texts[r][:DIGIT] if r == row else None for row, r in enumerate(first)], pa.binary()), pa.array([texts[r] if r == row else None for row, r in enumerate(first)], pa.binary()), *(c.slice(lo, len(raw)) for c in batch.columns[2:]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)
                at += len(raw)

    names = ["id", "uid", "rep", "n", "keep", "keep_id", "digest", "head", "text", *(["carried"] if carry else [])]
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *([F.struct(*[docs[f'`{c}`'] for c in carry]).alias("carried")] if carry else []))
    kind = source.schema["id"].dataType.simpleString()
    more = f", carried {source.schema['carried'].dataType.simpleString()}" if carry else ""
    return source.mapInArrow(run, f"id {kind}, uid bigint, rep bigint, n bigint, keep bigint, keep_id {kind}, digest string, head binary, text binary{more}")


def _finish(texts: DataFrame) -> DataFrame:
    """``uid, class`` of texts (``mark, uid, text``) that have an equal of their mark; a task holds some marks at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["mark"], GROUP_ROWS):
            uids = table.column("uid").to_pylist()
            first = radix_classes(table.column("text").to_pylist())
            shared = {rep for row, rep in enumerate(first) if rep != row}
            held = [(uids[row], uids[rep]) for row, rep in enumerate(first) if rep in shared]
            yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in held], pa.int64()) for k in (0, 1)], ["uid", "class"])

    dealt = texts.select("mark", "uid", "text").repartition(shuffle_width(texts.sparkSession), "mark").sortWithinPartitions("mark", "uid")
    return dealt.mapInArrow(run, "uid bigint, class bigint")


def _linked(reps: DataFrame) -> DataFrame:
    """``uid, class`` of the batches' first rows (``uid, head, text``; the head is the first digit) that equal one of another batch.

    Bit maps of the marks of groups (a hash that only says where to look) are all
    that is sent to every task: one leaves texts that are alone with their digit
    where they are, the other parts those of groups that go on to the next digit,
    with any whose mark falls on the same bit.
    """
    active, digit = reps.select("uid", F.lit(0).cast("bigint").alias("group"), "head", "text"), F.col("head")
    at, width, out, used = 0, DIGIT, [], []
    while True:
        marked = active.withColumns({"digit": digit, "size": F.octet_length("text").cast("bigint")}).withColumn("mark", F.xxhash64("group", "digit"))
        groups = materialise(marked.groupBy("group", "digit", "mark").agg(F.count("*").alias("c"), F.sum("size").alias("b"), F.min("uid").alias("next")).where("c > 1"), "radix-groups")
        over = F.octet_length("digit") < width
        near = ~over & (F.col("c") <= GROUP_ROWS) & (F.col("b") <= GROUP_BYTES)
        far, rest = parted(marked, groups.where(~near).select(F.col("mark").alias("id")), "mark")
        members = materialise(far.select("uid", "group", "digit").join(groups, ["group", "digit"]).select("uid", F.col("next").alias("group"), over.alias("over")), "radix-members")
        alike = parted(rest, groups.where(near).select(F.col("mark").alias("id")), "mark")[0]
        out += [materialise(_finish(alike), "radix-finished"), members.where("over").select("uid", F.col("group").alias("class"))]
        used += [groups, members, out[-2]]
        going = members.where("not over").select("uid", "group")
        if going.isEmpty():
            break
        held = parted(reps.select("uid", "text"), going.select(F.col("uid").alias("id")), "uid")[0]
        at, width = at + width, width * LONGER
        active, digit = held.join(going, "uid").select("uid", "group", "text"), F.substring("text", at + 1, width)
    linked = materialise(reduce(DataFrame.unionAll, out), "radix-classes")
    discard(*used)
    return linked


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row a row of ``docs``: its id, ``keep_id, group_size, kept, text_sha256`` and a struct ``carried`` of the columns ``carry``, if any.

    Texts are equal when they are after every run of ASCII white space is one
    space; null counts as empty, and empty texts are equal to each other. Of equal
    texts the row with the smallest id stays, rows without an id only where none has
    one; of repeated ids one row stays, whichever comes first. An empty table gives
    none. Other columns, whatever they are called, don't matter.
    """
    rows = materialise(_local(docs, id_col, text_col, list(carry)), "radix-rows")
    linked = _linked(rows.where("head is not null").select("uid", "head", "text"))
    firsts = rows.where("head is not null").select("uid", "n", F.struct(F.col("keep_id").isNull().alias("last"), F.col("keep_id").alias("id"), F.col("keep").alias("uid")).alias("best"))
    held = firsts.join(linked, "uid")
    whole = held.groupBy("class").agg(F.sum("n").alias("all_n"), F.min("best").alias("stays"))
    told = materialise(linked.join(whole, "class").select(F.col("uid").alias("rep"), "all_n", "stays"), "radix-told")
    discard(linked)
    out = rows.drop("head", "text").join(told, "rep", "left")
    better = F.col("stays").isNotNull()
    return out.select(
        F.col("id").alias(id_col), F.when(better, F.col("stays.id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("all_n", "n").alias("group_size"), (F.col("uid") == F.when(better, F.col("stays.uid")).otherwise(F.col("keep"))).alias("kept"), F.col("digest").alias("text_sha256"), *(["carried"] if carry else [])
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all of their columns."""
    return exact_classes(docs, id_col, text_col, tuple(docs.columns)).where("kept").select("carried.*")


def op13_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_classes(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
