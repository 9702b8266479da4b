"""Near-duplicates by Jaccard similarity of word shingles: SimHash links, and an exact prefix-filter join for the rest.

The Gray-order index of ``simhash`` finds fingerprints of the shingle sets at 4
or fewer differing bits. Most pairs from a similarity of 0.8 on differ in more,
so a join that misses none follows for what is not yet in one component.

Two sets with a Jaccard similarity of at least s share an element among the first
n - ceil(s * n) + 1 of each, in any fixed order of all elements. Here frequent
shingles come last, so that few documents meet at one shingle.

Prefixes longer by k shingles share k or more: of the two, take the set whose
prefix ends first; at most its last ceil(s * n) - k shingles lie behind it, and
what it shares before that is in the other's prefix too. So a document of whose
longer prefix fewer shingles are in any other prefix is in no pair. It is left
out before any pair is made. k is a share of n, and as partners have ceil(s * n)
shingles at least, the k of that size is what is asked for.

A sample can't tell how many documents hold a shingle that is in few of its own.
So all shingles of the documents that are left are counted, and their prefixes
are made anew, the shingles in the fewest documents first. What many documents
quote comes last, and documents that have a fifth of their own, or share it with
few, don't meet at it, however many they are.

Both rounds compare whole shingle sets, so that no pair is missed and none is
wrong. The first takes one partner a document and shingle; the last one compares
what meets and is not yet in one component, a pair where it meets first.

Before whole texts are sent, a sketch is: how many shingles of a set fall into
each of SKETCH parts of the hash range. Two sets differ in at least as many
shingles as their counts differ in sum, so a pair whose counts differ in more
than the similarity allows is no link, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import connected_components, discard, group_starts, materialise, mixed, parted, shuffle_width, whole_groups

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
SAMPLE = 6_000
OFTEN = 2
#: documents of a shingle that meet in one task; more are cut into blocks, which changes no result
CAP = 256
#: parts of the hash range that a sketch counts; a power of two
SKETCH = 512
#: prefixes are longer by a set's size over this
LONGER = 8
#: how often documents that share too little are left out, each time among those that were left
LEFT_OUT = 2


def shingles(text: str | None, words: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; a text of fewer words is one shingle, one without words the shingle 0."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not parts:
        return np.zeros(1, np.uint64)
    seen: dict[bytes, int] = {}
    h = np.fromiter((seen[p] if p in seen else seen.setdefault(p, xxh64_intdigest(p, seed)) for p in parts), np.uint64, len(parts))
    k = min(words, len(parts))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = mixed(out * _FACTOR + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def _least_shared(size: np.ndarray | int, num: int, den: int):
    """Smallest whole number of at least ``num / den`` times ``size``."""
    return -(-size * num // den)


def _longer(size: int) -> int:
    """Shingles that longer prefixes share at least, where the smaller set has ``size``; the first of them is in the plain prefixes."""
    return max(1, size // LONGER)


def sketch(s: np.ndarray) -> bytes:
    """How many of a set's shingles fall into each of SKETCH equal parts of the hash range, 255 at most."""
    part = (s >> np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.intp)
    return np.minimum(np.bincount(part, minlength=SKETCH), 255).astype(np.uint8).tobytes()


def prefixes(docs: DataFrame, frequent: np.ndarray, words: int, num: int, den: int) -> DataFrame:
    """``(id, n, s1, s2, fp, sketch, rare, tokens)``: size, two hashes, SimHash and sketch of the shingle set, and its longer prefix, the ``rare`` shingles before those in ``frequent``."""
    held = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = held.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                n, s1, s2, fp, counts, rare, tokens = [], [], [], [], [], [], []
                for t in part.column(1):
                    s = shingles(t.as_py(), words)
                    at = np.searchsorted(often, s)
                    late = often[np.minimum(at, len(often) - 1)] == s if len(often) else np.zeros(len(s), bool)
                    n.append(len(s))
                    rare.append(len(s) - int(late.sum()))
                    fp.append(simhash.majority(s))
                    counts.append(sketch(s))
                    s1.append(int(mixed(s.copy()).sum().view(np.int64)))
                    s2.append(int(mixed(s * _FACTOR + np.uint64(1)).sum().view(np.int64)))
                    tokens.append(np.concatenate([s[~late], s[late]])[: len(s) - _least_shared(len(s), num, den) + _longer(len(s))].view(np.int64))
                ends = np.cumsum([0, *map(len, tokens)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int32()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(counts, pa.binary()), pa.array(rare, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(tokens)))], ["id", "n", "s1", "s2", "fp", "sketch", "rare", "tokens"])

    return docs.mapInArrow(run, "id bigint, n int, s1 bigint, s2 bigint, fp bigint, sketch binary, rare int, tokens array<bigint>")


def frequent_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """Sorted shingles that ``OFTEN`` or more texts of a bounded sample hold. They only set the order, never what is compared."""
    every = max(1, docs.count() // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t.as_py(), words).view(np.int64))], ["token"])

    some = docs.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("text").mapInArrow(run, "token bigint")
    rows = some.groupBy("token").count().where(F.col("count") >= OFTEN).select("token").toArrow()
    return np.sort(rows.column("token").to_numpy().view(np.uint64))


def counted(rows: DataFrame) -> DataFrame:
    """``rows`` of shingles that more than one document holds, with how many do."""
    return rows.withColumn("size", F.count("*").over(Window.partitionBy("token"))).where("size > 1")


def with_counts(few: DataFrame, often: DataFrame, name: str) -> DataFrame:
    """Rows of shingles that more than one row has, with how many do as ``name``.

    One shuffle brings the rows of rare shingles together, which counts them.
    Rows of frequent ones stay where they are; only their counts are broadcast,
    of no more shingles than the bounded sample has.
    """
    sizes = often.groupBy("token").agg(F.count("*").alias(name)).where(f"{name} > 1")
    few = counted(few).withColumnRenamed("size", name)
    return few.unionAll(often.join(F.broadcast(sizes), "token").select(few.columns))


def all_shingles(texts: DataFrame, frequent: np.ndarray, words: int, often: bool) -> DataFrame:
    """``(rep, whole, token)``: all shingles of ``texts(id, text)`` in ``frequent``, or all others. ``whole`` is the set's size times 2**32 plus 32 bits of its hash, which tells sets of one id apart."""
    held = texts.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = held.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rep, whole, tokens = [], [], []
                for i, t in zip(batch.column(0).slice(lo, 256).to_pylist(), batch.column(1).slice(lo, 256).to_pylist(), strict=True):
                    s = shingles(t, words)
                    rep.append(i)
                    whole.append((len(s) << 32) + (int(mixed(s.copy()).sum()) & 0xFFFFFFFF))
                    at = np.searchsorted(late, s)
                    tokens.append(s[(late[np.minimum(at, len(late) - 1)] == s) == often] if len(late) else s[: 0 if often else None])
                size = [*map(len, tokens)]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(rep, np.int64), size)), pa.array(np.repeat(np.array(whole, np.int64), size)), pa.array(np.concatenate(tokens).view(np.int64))], ["rep", "whole", "token"])

    return texts.mapInArrow(run, "rep bigint, whole bigint, token bigint")


def shared_rows(points: DataFrame, texts: DataFrame, frequent: np.ndarray, words: int, num: int, den: int) -> DataFrame:
    """``(rep, place, token, prev, size)``: shingles of prefixes that more than one document holds, with the set's size times 2**32 plus the shingle's place, the set's shingle before it (0: none), and how many hold it.

    Documents that share too little of their longer prefixes are left out; frequent
    shingles count as shared there. Prefixes of the others are made anew, the
    shingles that the fewest of them hold first. Shingles that one holds come before
    all others, so that their number does for the places behind them.
    """
    least = f"(({{0}} * {num} + {den - 1}) div {den})"
    few = points.select(F.col("id").alias("rep"), "rare", F.posexplode("tokens").alias("pos", "token")).where("pos < rare").select("rep", "token")
    asked = points.select(F.col("id").alias("rep"), F.expr(f"greatest(1, {least.format('n')} div {LONGER}) - greatest(0, size(tokens) - rare)").alias("asked"))
    held: list[DataFrame] = []
    for _ in range(LEFT_OUT):
        held.append(materialise(counted(few).drop("size"), "jaccard-few"))
        sums = held[-1].groupBy("rep").agg(F.count("*").alias("shared"))
        asked = materialise(asked.join(sums, "rep", "left").where("coalesce(shared, 0) >= asked").drop("shared"), "jaccard-asked")
        kept = asked.select(F.col("rep").alias("id"))
        few = parted(held[-1], kept, "rep")[0]
    left = texts_of(texts, kept)
    rows = with_counts(*(all_shingles(left, frequent, words, often).withColumn("often", F.lit(often)) for often in (False, True)), "holders")
    own = Window.partitionBy("rep", "whole")
    rows = rows.withColumn("rank", F.dense_rank().over(own.orderBy("holders", "token"))).withColumn("prev", F.lag("token", 1, 0).over(own.orderBy("holders", "token")))
    n = F.shiftright("whole", 32)
    rows = rows.withColumn("n", n).withColumn("pos", n - F.max("rank").over(own) + F.col("rank") - 1).where(f"pos <= n - {least.format('n')}")
    cut = materialise(rows.select("rep", (F.shiftleft("n", 32) + F.col("pos")).alias("place"), "token", "prev", "often"), "jaccard-prefixes")
    out = materialise(with_counts(cut.where("not often"), cut.where("often"), "size").drop("often"), "jaccard-groups")
    discard(*held, left, cut)
    return out


def texts_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """``(id, text)``: the texts among ``ids``. Texts are smaller than their shingle sets, which are made again where they are compared."""
    some = parted(texts, ids, "id")[0].join(ids, "id", "left_semi")
    return materialise(some.select("id", "text"), "jaccard-texts")


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()


def in_components(groups: DataFrame, comp: DataFrame) -> DataFrame:
    """``groups`` with the component of each document: itself where it has no link yet."""
    return groups.join(comp.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def dealt_by_task(rows: DataFrame) -> DataFrame:
    """Rows of one task together, by rising size. Tasks are 64-bit hashes: two that fall together only add pairs to be verified."""
    return rows.repartition(shuffle_width(rows.sparkSession), "task").sortWithinPartitions("task", "place")


def first_pairs(groups: DataFrame, num: int, den: int, cap: int = CAP) -> DataFrame:
    """Each document with the one of the smallest id, or itself being that the largest, that it meets at a shingle among those of its size and of the next smaller.

    A shingle of more than ``cap`` documents is cut into blocks, other ones at each shingle, so that blocks link.
    """
    block = F.pmod(F.xxhash64("rep", "token"), F.ceil(F.col("size") / cap))
    dealt = dealt_by_task(groups.select(F.xxhash64("token", block).alias("task"), "rep", "place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["task"], 1 << 16):
            task, rep, place = (table.column(c).to_numpy() for c in ("task", "rep", "place"))
            n, pos = place >> 32, place & 0xFFFFFFFF
            bucket = np.floor(np.log(n) / np.log(den / num)).astype(np.int64)
            starts = group_starts(task, bucket)
            own = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(rep))))
            by_id = np.lexsort((rep, own))
            low, high = by_id[starts], by_id[np.append(starts[1:], len(rep)) - 1]
            smaller = np.maximum(own - 1, 0)
            next_ = (task[starts[smaller]] == task) & (bucket[starts[smaller]] == bucket - 1)
            a, b = [], []
            for at, there in ((own, True), (smaller, next_)):
                mate = np.where(rep[low[at]] != rep, low[at], high[at])
                ok = there & (rep[mate] != rep) & (np.minimum(n - pos, n[mate] - pos[mate]) * (num + den) >= num * (n + n[mate]))
                a.append(np.minimum(rep, rep[mate])[ok])
                b.append(np.maximum(rep, rep[mate])[ok])
            a, b = np.concatenate(a), np.concatenate(b)
            order = np.lexsort((b, a))
            once = order[group_starts(a[order], b[order])]
            yield pa.RecordBatch.from_arrays([pa.array(a[once]), pa.array(b[once])], ["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def simhash_pairs(points: DataFrame, most: int = 4) -> DataFrame:
    """Links of ``points(id, fp)`` by the Gray-order index: equal fingerprints, and those at ``most`` or fewer differing bits."""
    first = materialise(points.groupBy("fp").agg(F.min("id").alias("rep")), "jaccard-points")
    equal = points.join(first, "fp").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    near = simhash.hamming_links(first, most).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return equal.unionAll(near)


def possible(pairs: DataFrame, marks: DataFrame, num: int, den: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sketches in ``marks(id, n, sketch)`` leave room for a similarity of ``num / den``."""
    held = parted(marks.select("id", "n", "sketch"), ends(pairs), "id")[0]
    left, right = (held.select(F.col("id").alias(k), F.col("n").alias("n" + k), F.col("sketch").alias("k" + k)) for k in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH).astype(np.int16) for c in ("ka", "kb"))
            size = batch.column("na").to_numpy().astype(np.int64) + batch.column("nb").to_numpy()
            ok = pa.array(np.abs(x - y).sum(1, dtype=np.int64) * (num + den) <= size * (den - num))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], ["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ka", "kb").mapInArrow(run, "a bigint, b bigint").distinct()


def verified(pairs: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose texts in ``texts(id, text)`` have a Jaccard similarity of ``num / den`` or more of all their shingles."""
    left, right = texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets: dict[str | None, np.ndarray] = {}
                ok = np.zeros(part.num_rows, bool)
                for i, two in enumerate(zip(part.column("ta").to_pylist(), part.column("tb").to_pylist(), strict=True)):
                    x, y = (sets[t] if t in sets else sets.setdefault(t, shingles(t, words)) for t in two)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok[i] = both * den >= num * (len(x) + len(y) - both)
                yield pa.RecordBatch.from_arrays([part.column("a").filter(pa.array(ok)), part.column("b").filter(pa.array(ok))], ["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def open_pairs(groups: DataFrame, comp: DataFrame, num: int, den: int, cap: int = CAP) -> DataFrame:
    """Pairs that meet at a shingle, may reach the similarity by their sizes and places, and are in different components.

    A shingle of more than ``cap`` documents is cut into blocks, and each pair of blocks is a task's group.
    """
    rows = in_components(groups, comp)
    large = rows.where(F.col("size") > cap).withColumn("nb", F.ceil(F.col("size") / cap).cast("int"))
    mixed_ = large.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("nb").alias("nb")).where("lo < hi")
    mixed_ = mixed_.select("token", F.explode(F.expr("sequence(0, nb - 1)")).alias("own"))
    parts = (
        large.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
        .join(mixed_, ["token", "own"])
        .withColumn("other", F.explode(F.expr("sequence(0, nb - 1)")))
        .select(F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other")).alias("task"), "rep", "place", "prev", "component")
    )
    dealt = dealt_by_task(rows.where(F.col("size") <= cap).select(F.xxhash64("token").alias("task"), "rep", "place", "prev", "component").unionAll(parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["task"], 1 << 16):
            task, rep, place, prev, comp_ = (table.column(c).to_numpy() for c in ("task", "rep", "place", "prev", "component"))
            n, pos = place >> 32, place & 0xFFFFFFFF
            starts = group_starts(task)
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(rep)]):
                for i in range(lo, hi - 1):
                    # sizes rise: the last partner is the last one not too long
                    end = lo + int(np.searchsorted(n[lo:hi], n[i] * den // num, "right"))
                    j = np.arange(i + 1, end)
                    if not len(j):
                        continue
                    need = _least_shared(n[i] + n[j], num, num + den)
                    # two that share the shingle before this one have met there
                    j = j[(comp_[j] != comp_[i]) & ((prev[j] != prev[i]) | (prev[i] == 0)) & (1 + np.minimum(n[i] - pos[i] - 1, n[j] - pos[j] - 1) >= need)]
                    if len(j):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(rep[i], rep[j])), pa.array(np.maximum(rep[i], rep[j]))], ["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """``(doc_id, component_id)``: documents link at a Jaccard similarity of ``num / den`` or more
    of their shingle sets; component_id is the smallest id reachable, its own included.

    Ids are integers; a row without one is left out. Rows that repeat an id are
    one document if their texts are equal, and else share the class of either.
    Texts without words are equal.
    """
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("id"), "text")
    frequent = frequent_shingles(texts, words)
    marks = materialise(prefixes(texts, frequent, words, num, den), "jaccard")
    # equal sets are one point
    same = materialise(marks.groupBy("s1", "s2").agg(F.min("id").alias("rep")), "jaccard-same")
    named = marks.select("id", "s1", "s2").join(same, ["s1", "s2"])
    repeats = materialise(named.where("id <> rep").select("id").join(same.select(F.col("rep").alias("id")), "id", "left_anti").distinct(), "jaccard-repeats")
    unsure, points = parted(marks, repeats, "id")
    points = points.unionAll(unsure.join(repeats, "id", "left_anti").select(marks.columns))
    groups = shared_rows(points, texts, frequent, words, num, den)
    links: list[DataFrame] = []
    for last in (False, True):
        # at first one partner a document and shingle, so that what is left for the last step is little
        pairs = open_pairs(groups, comp, num, den) if last else first_pairs(groups, num, den).unionAll(simhash_pairs(points.select("id", "fp"))).distinct()
        met = materialise(pairs, "jaccard-met")
        pairs = materialise(possible(met, marks, num, den), "jaccard-pairs")
        held = texts_of(texts, ends(pairs))
        links.append(materialise(verified(pairs, held, words, num, den), "jaccard-links"))
        discard(met, pairs, held)
        comp = connected_components(reduce(DataFrame.unionAll, links))
    discard(groups)
    named = same.join(comp, same.rep == comp.id, "left").select("s1", "s2", F.coalesce("component", "rep").alias("component_id"))
    out = materialise(marks.select("id", "s1", "s2").join(named, ["s1", "s2"]).select(F.col("id").alias("doc_id"), "component_id"), "jaccard-classes")
    discard(marks, same, repeats, *links)
    return out


def drop_near_duplicates(docs: DataFrame, words: int = 5) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate class, and rows without an id.

    Repeated rows of a document that stays all stay; empty tables stay empty;
    columns may have any name.
    """
    classes = near_duplicates(docs, words)
    gone = materialise(classes.where("doc_id <> component_id").select(F.col("doc_id").alias("id")), "jaccard-gone")
    unsure, kept = parted(docs, gone, "doc_id")
    return kept.unionAll(unsure.join(gone, unsure.doc_id == gone.id, "left_anti"))
