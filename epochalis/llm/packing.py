"""Packing tokenised documents into fixed-length sequences by cutting stock.

1. Arrow workers tokenise each text, cut it into full sequences and one tail,
   and write a row a piece; each piece gets its rank among the pieces of its
   length class in its task, so that ranks need no global sort.
2. The length histogram (a few hundred classes, whatever the corpus) goes to
   the driver, where a linear program over cutting patterns is solved by column
   generation: a knapsack dynamic program prices new patterns until the bound
   shows that no pattern can lower the number of sequences by more than ``gap``.
3. Pattern counts are rounded down, the few pieces left are packed best-fit,
   and every piece finds its sequence from its global rank in its class.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, read_table

CAPACITY = 1024
#: lengths up to FINE are classes of their own; longer ones round up to GRAIN
FINE, GRAIN = 48, 8


@lru_cache(maxsize=4)
def encoder(json_path: str, ranks_path: str):
    """Function text -> uint32 ids, equal to ``tokenizers`` on ``json_path``.

    The rank file holds the same vocabulary in a faster library; a text that
    spells a special token, or that it refuses, goes to ``tokenizers``.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(json_path)
    special = [t.content for t in exact.get_added_tokens_decoder().values()]
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if not any(s in text for s in special):
            try:
                return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
            except Exception:  # noqa: BLE001  e.g. the pattern engine's stack on a huge run of blanks
                pass
        return np.array(exact.encode(text, add_special_tokens=False).ids, "<u4")

    return encode


def public_encoder():
    import public_tokenizers as p

    return encoder(p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"))


def size_class(length: np.ndarray, capacity: int) -> np.ndarray:
    """Size that a piece is planned with: its length, rounded up to GRAIN beyond FINE."""
    up = np.minimum(-(-length // GRAIN) * GRAIN, capacity)
    return np.where(length <= FINE, length, up)


def cut_pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """Rows ``(doc, start, length, ids_crc32, doc_tokens, pid, cls, rank)`` and ``ids`` on request."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = public_encoder()
        pid = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4")
        for batch in batches:
            doc, start, length, crc, total, held = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                ids = np.concatenate((encode(text.as_py() or ""), end))
                raw = memoryview(ids).cast("B")
                n = len(ids)
                for lo in range(0, n, capacity):
                    hi = min(n, lo + capacity)
                    doc.append(row)
                    start.append(lo)
                    length.append(hi - lo)
                    crc.append(zlib.crc32(raw[4 * lo : 4 * hi]))
                    total.append(n)
                    if with_ids:
                        held.append(ids[lo:hi].astype(np.int32))
            if not doc:
                continue
            cls = size_class(np.array(length), capacity)
            order = np.argsort(cls, kind="stable")
            counts = np.bincount(cls, minlength=capacity + 1)
            first = np.cumsum(counts) - counts
            rank = np.empty(len(cls), np.int64)
            rank[order] = np.arange(len(cls)) - first[cls[order]] + seen[cls[order]]
            seen += counts
            columns = [batch.column(0).take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (start, length, crc, total)), pa.array(np.full(len(doc), pid)), pa.array(cls, pa.int64()), pa.array(rank)]
            if with_ids:
                columns.append(pa.array(held, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc", "start", "length", "ids_crc32", "doc_tokens", "pid", "cls", "rank"] + ["ids"] * with_ids
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc {kind}, " + ", ".join(f"{n} bigint" for n in names[1:8]) + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def best_knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Most valuable pattern, any number of each size: dynamic program over the capacity."""
    use = np.flatnonzero(values > 1e-12)
    sizes_, values_ = sizes[use], values[use]
    order = np.argsort(sizes_, kind="stable")
    use, sizes_, values_ = use[order], sizes_[order], values_[order]
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes_, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            got = values_[:k] + best[c - sizes_[:k]]
            i = int(got.argmax())
            if got[i] > best[c] + 1e-12:
                best[c], pick[c] = got[i], i
    pattern, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            pattern[use[pick[c]]] += 1
            c -= int(sizes_[pick[c]])
    return float(best[capacity]), pattern


def fullest_pattern(sizes: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """The largest piece left and the pieces that fill its sequence best: subset sums as bit sets."""
    pattern = np.zeros(len(sizes), np.int64)
    falling = [i for i in np.argsort(-sizes, kind="stable") if left[i]]
    pattern[falling[0]] = 1
    room = capacity - int(sizes[falling[0]])
    parts, reach, mask = [], [1], (1 << (room + 1)) - 1
    for i in falling:
        copies, k = int(left[i]) - int(pattern[i]), 1
        copies = min(copies, room // int(sizes[i]))
        while copies and not reach[-1] >> room & 1:
            k = min(k, copies)
            parts.append((i, k))
            reach.append((reach[-1] | reach[-1] << k * int(sizes[i])) & mask)
            copies, k = copies - k, 2 * k
    at = reach[-1].bit_length() - 1
    for (i, k), before in zip(reversed(parts), reversed(reach[:-1])):
        if not before >> at & 1:
            pattern[i] += k
            at -= k * int(sizes[i])
    return pattern


def greedy_fill(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """``(times, pattern, sizes it exhausts)`` by ``fullest_pattern``, each used as often as it can be."""
    plan, left = [], left.copy()
    while left.any():
        pattern = fullest_pattern(sizes, left, capacity)
        used = pattern > 0
        times = int(min(left[used] // pattern[used]))
        left -= times * pattern
        plan.append((times, pattern, np.flatnonzero(used & (left == 0))))
    return plan


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 5e-4, rounds: int = 1500) -> list[tuple[int, np.ndarray]]:
    """``(times, pattern)`` covering the demand of every size; a pattern fits the capacity.

    Revised simplex on ``min sum x, A x >= demand``, begun from one greedy pattern
    for each size that it exhausts (a triangular basis). With v the value of the
    best pattern under the dual prices, ``sum x / v`` bounds the optimum from below,
    as does the plain volume; the loop ends once sum x is within ``gap`` of the bound.
    """
    m = len(sizes)
    if not m:
        return []
    columns, cost = [], np.ones(m)
    done = np.zeros(m, bool)
    for _, pattern, ended in greedy_fill(sizes, demand, capacity):
        for k, i in enumerate(i for i in ended if not done[i]):
            columns.append(pattern if k == 0 else np.where(np.arange(m) == i, capacity // sizes[i], 0))
            done[i] = True
    inverse = np.linalg.inv(np.array(columns, float).T)
    x = np.maximum(inverse @ demand, 0)
    bound = demand @ sizes / capacity
    for step in range(rounds):
        if cost @ x <= bound * (1 + gap):
            break
        y = cost @ inverse
        low = int(y.argmin())
        if y[low] < -1e-9:
            column, price = -np.eye(m, dtype=np.int64)[low], 0.0
        else:
            value, column = best_knapsack(sizes, y, capacity)
            bound = max(bound, cost @ x / max(value, 1))
            if value <= 1 + 1e-9:
                break
            price = 1.0
        d = inverse @ column
        ratio = np.where(d > 1e-7, x / np.where(d > 1e-7, d, 1), np.inf)
        t = ratio.min()
        if not np.isfinite(t):
            break
        out = int(np.where(ratio <= t + 1e-9, d, 0).argmax())  # of ties, the steadiest pivot
        x = x - t * d
        x[out] = t
        inverse[out] /= d[out]
        others = np.arange(m) != out
        inverse[others] -= d[others, None] * inverse[out]
        columns[out], cost[out] = column, price
        if step % 64 == 63:  # rounding errors
            try:
                inverse = np.linalg.inv(np.array(columns, float).T)
            except np.linalg.LinAlgError:  # a basis too near to singular to go on from; x still covers
                break
            x = np.maximum(inverse @ demand, 0)
    plan, left = [], demand.astype(np.int64).copy()
    for i in range(m):
        used = columns[i] > 0
        if cost[i] and used.any():
            times = min(int(np.floor(x[i] + 1e-9)), int(min(left[used] // columns[i][used])))
            if times > 0:
                plan.append((times, columns[i]))
                left -= times * columns[i]
    return plan + [(times, pattern) for times, pattern, _ in greedy_fill(sizes, left, capacity)]


def slot_table(sizes: np.ndarray, plan: list[tuple[int, np.ndarray]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Size -> (first rank, copies a sequence, first sequence) of each of its patterns."""
    out, base = {int(s): ([0], [], []) for s in sizes}, 0
    for times, pattern in plan:
        for i in np.flatnonzero(pattern):
            starts, copies, firsts = out[int(sizes[i])]
            copies.append(int(pattern[i]))
            firsts.append(base)
            starts.append(starts[-1] + times * int(pattern[i]))
        base += times
    return {s: (np.array(a[:-1]), np.array(c), np.array(f)) for s, (a, c, f) in out.items()}


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, gap: float = 5e-4, with_ids: bool = False) -> DataFrame:
    """One row a piece: ``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A null or empty text is the end id alone. A text of any length is cut into
    full sequences and a tail. Repeated rows and ids are packed as rows of their
    own, null ids too; other columns are ignored; an empty table gives no rows.
    ``with_ids`` adds the ids (array<int>), from which ``sequences`` builds text-free input.
    """
    pieces = materialise(cut_pieces(docs, id_col, text_col, capacity, end_id, with_ids), "pack")
    counts = pieces.groupBy("pid", "cls").agg((F.max("rank") + 1).alias("n"))
    # a class has one row a task here, never one a document
    before = Window.partitionBy("cls").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialise(counts.select("pid", "cls", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "pack-counts")
    # at most FINE + capacity / GRAIN rows
    histogram = sorted((r["cls"], r["n"]) for r in counts.groupBy("cls").agg(F.sum("n").alias("n")).collect())
    sizes, demand = (np.array([h[k] for h in histogram], np.int64) for k in (0, 1))
    slots = slot_table(sizes, cutting_stock(sizes, demand, capacity, gap))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("cls", "rank"))
            found = np.empty(len(cls), np.int64)
            for c in np.unique(cls):
                at = np.flatnonzero(cls == c)
                starts, copies, firsts = slots[int(c)]
                k = np.searchsorted(starts, rank[at], "right") - 1
                found[at] = firsts[k] + (rank[at] - starts[k]) // copies[k]
            keep = batch.select(list(kept))
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(found)], [*kept, "sequence_id"])

    kept = ["doc", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    ranked = pieces.join(counts.select("pid", "cls", "before"), ["pid", "cls"]).withColumn("rank", F.col("rank") + F.col("before"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.select(kept).schema) + ", sequence_id bigint"
    placed = ranked.select(*kept, "cls", "rank").mapInArrow(place, schema)
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc", "start", "ids_crc32")
    offset = F.coalesce(F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("offset", offset).withColumnRenamed("doc", id_col)


def sequences(pieces: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """Token sequences of ``pack(..., with_ids=True)``: ``sequence_id, input_ids, n_ids``, padded to the capacity."""
    held = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    flat = F.flatten(F.transform("p", lambda x: x["ids"]))
    padded = F.slice(F.concat(flat, F.array_repeat(F.lit(pad_id), capacity)), 1, capacity)
    return held.select("sequence_id", padded.alias("input_ids"), F.size(flat).alias("n_ids"))


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
