"""Repair of conversations: the cheapest edits after which roles read ``(s?(ua)+)?`` and no row is blank or said twice.

Edits are arcs of a graph over (rows used up, role before): Keep, Rerole and
Delete use up a row, Insert doesn't. Least costs from the start and to the end
show which arcs are tight, that is, on some cheapest path; a frontier that follows
the tight arcs of the least letter writes the least of the cheapest audits. (A
letter and the role before fix the role after, so a frontier never grows.)

A conversation of any length is cut into chunks of rows in a global sort. A chunk
is a matrix of least costs from each role before to each role after it; running
products of those matrices, forward and backward, give the costs at its borders,
so that every chunk finds its tight arcs by itself. Only what the contract makes
serial, a digest over all turns in order, sees a whole conversation, row by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import materialise, read_table, shuffle_width

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
CHUNK = 4096
_SPACES = " \t\n\x0b\x0c\r"
#: role before: none, s, u, a; the role that a user or assistant turn has after it
NEXT = (2, 2, 3, 2)
ROLES = {2: "user", 3: "assistant"}
_INITIALS = {"s": 1, "u": 2, "a": 3}
_TRUNCATED, _GONE = 4, 8
_FAR = 1 << 60
_LEGAL = {"su", "ua", "au"}


@lru_cache(None)
def row_arcs(code: int) -> tuple:
    """For each role before: (letter, role after, cost) of the edits that use up a row of this code."""
    initial, extra = code & 3, TRUNCATED * bool(code & _TRUNCATED)
    out = []
    for before in range(4):
        arcs = [("D", before, DELETE)]
        if not code & _GONE:
            if initial == 1 and before == 0 or initial > 1 and NEXT[before] == initial:
                arcs.append(("K", initial, KEEP + extra))
            arcs.append(("R", NEXT[before], REROLE + extra))
        out.append(tuple(arcs))
    return tuple(out)


def after_inserts(cost: tuple) -> tuple:
    """Least costs from the start once any inserts are made."""
    u = min(cost[2], INSERT + min(cost[0], cost[1], cost[3]))
    return cost[0], cost[1], u, min(cost[3], INSERT + u)


def before_inserts(cost: tuple) -> tuple:
    """Least costs to the end if inserts may come first."""
    u, a = min(cost[2], INSERT + cost[3]), min(cost[3], INSERT + cost[2])
    return min(cost[0], INSERT + u), min(cost[1], INSERT + u), u, a


#: least costs to the end of a conversation after its last row
AT_END = before_inserts((0, _FAR, _FAR, 0))


@lru_cache(1 << 14)
def through(codes: bytes) -> tuple:
    """Least costs from each role before a chunk (rows) to each role after its last row."""
    out = []
    for start in range(4):
        cost = tuple(0 if k == start else _FAR for k in range(4))
        for code in codes:
            cost, arcs, new = after_inserts(cost), row_arcs(code), [_FAR] * 4
            for before in range(4):
                for _, after, price in arcs[before]:
                    new[after] = min(new[after], cost[before] + price)
            cost = tuple(new)
        out.append(cost)
    return tuple(out)


@lru_cache(1 << 14)
def walk(codes: bytes, to_end: tuple, start: int, last: bool) -> tuple[str, int]:
    """Least letters along tight arcs from the role ``start`` before a chunk, and the role after it.

    ``to_end``: least costs from after the chunk to the conversation's end.
    """
    costs = [to_end]
    for code in reversed(codes):
        nearer, arcs = costs[-1], row_arcs(code)
        costs.append(before_inserts(tuple(min(price + nearer[after] for _, after, price in arcs[before]) for before in range(4))))
    costs.reverse()
    frontier, at, audit = {start}, 0, []
    while True:
        tight: dict[str, set[int]] = {}
        for before in frontier:
            here = costs[at][before]
            if at < len(codes):
                for letter, after, price in row_arcs(codes[at])[before]:
                    if price + costs[at + 1][after] == here:
                        tight.setdefault(letter, set()).add(after)
            elif not last or here == 0:
                return "".join(audit), before
            if INSERT + costs[at][NEXT[before]] == here:
                tight.setdefault("I", set()).add(NEXT[before])
        letter = min(tight)
        frontier, at = tight[letter], at + (letter != "I")
        audit.append(letter)


def _streamed(df: DataFrame, run, schema: str) -> DataFrame:
    """``run`` takes an iterator of a task's rows and gives rows of ``schema``; a few are held at once."""
    kind = to_arrow_schema(T.StructType.fromDDL(schema))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kind)], schema=kind)

        held, size = [], 0
        for row in run(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))):
            held.append(row)
            size += 256 + sum(len(v) for v in row if isinstance(v, (str, bytes)))
            if size > 8 << 20:
                yield pack()
                held, size = [], 0
        if held:
            yield pack()

    return df.mapInArrow(go, schema)


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies``: rows after the damage that the numbers ``crc32(conv_id:turn) % 20`` below 5 do; a null counts as one space."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn"))) % 20
    held = rows.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return held.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).cast("bigint").alias("copies"))


def _ordered(rows: DataFrame, chunk_rows: int) -> DataFrame:
    """Chunks of rows in order, and the rows that may stay.

    A chunk is one row with ``codes`` (a byte a row) and what counts need; a row that
    may stay has its ``place`` among the codes, its role and its text. Chunks of a
    conversation are in the order of ``section, chunk``.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    told = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "copies")
    one = told.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    firsts = one.groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("text").alias("_t")).agg(F.min(when).alias("_first"))
    held = one.join(firsts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("text") == F.col("_t"))).select("conv_id", "turn", "role", "text", "copies", (F.col("_first") < when).alias("again"))

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        section, chunk = TaskContext.get().partitionId(), -1
        now = object()
        codes = bytearray()
        counts: list = []

        def told() -> tuple:
            blank, again, cut, illegal, first, last, lo, hi, turns = counts
            return (now, section, chunk, -1, None, None, bytes(codes), blank, again, cut, illegal, first, last, lo, hi, turns)

        def begin() -> None:
            nonlocal chunk, counts
            chunk += 1
            codes.clear()
            counts = [0, 0, 0, 0, None, None, None, None, 0]

        for conv, turn, role, text, copies, again in rows:
            if chunk < 0 or conv != now or len(codes) >= chunk_rows:
                if codes:
                    yield told()
                begin()
                now = conv
            said = text.strip(_SPACES)
            initial = role[:1]
            cut = bool(said) and said[-1] not in ".!?"
            for copy in range(copies):
                if len(codes) >= chunk_rows:
                    yield told()
                    begin()
                gone = not said or again or copy > 0
                if not gone:
                    yield (now, section, chunk, len(codes), role, text, *[None] * 10)
                codes.append(_INITIALS.get(initial, 0) + (_GONE if gone else _TRUNCATED * cut))
                counts[0 if not said else 1] += gone
                counts[2] += cut and not gone
                if counts[4] is None:
                    counts[4] = initial
                else:
                    counts[3] += counts[5] + initial not in _LEGAL
                counts[5] = initial
                if turn is not None and turn != counts[7]:
                    counts[6] = turn if counts[6] is None else counts[6]
                    counts[7], counts[8] = turn, counts[8] + 1
        if codes:
            yield told()

    order = ["conv_id", "turn", "role"]
    dealt = held.repartitionByRange(shuffle_width(rows.sparkSession), *order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
    schema = f"conv_id {kind}, section int, chunk bigint, place bigint, role string, text string, codes binary, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, lo bigint, hi bigint, turns bigint"
    return _streamed(dealt, run, schema)


def _by_conversation(chunks: DataFrame, backwards: bool = False) -> DataFrame:
    order = [F.desc, F.desc] if backwards else [F.asc, F.asc]
    return chunks.sortWithinPartitions("conv_id", *[f(c) for f, c in zip(order, ("section", "chunk"))])


def _audited(chunks: DataFrame) -> DataFrame:
    """Adds to each chunk ``before``, the role before it, and ``audit``, its letters.

    Three passes over chunks, which hold a byte a row: costs from the start, costs
    to the end, and the choice among what each chunk found for the roles that it may
    begin with.
    """
    kind = chunks.schema["conv_id"].dataType.simpleString()
    key = f"conv_id {kind}, section int, chunk bigint, codes binary"
    width = shuffle_width(chunks.sparkSession)

    def forward(rows: Iterator[tuple]) -> Iterator[tuple]:
        now, cost = object(), ()
        for conv, section, chunk, codes in rows:
            if conv != now:
                now, cost = conv, (0, _FAR, _FAR, _FAR)
            yield conv, section, chunk, codes, cost
            table = through(codes)
            cost = tuple(min(cost[k] + table[k][after] for k in range(4)) for after in range(4))

    def backward(rows: Iterator[tuple]) -> Iterator[tuple]:
        now, cost = object(), ()
        for conv, section, chunk, codes, come in rows:
            last = conv != now
            if last:
                now, cost = conv, AT_END
            yield conv, section, chunk, codes, come, cost, last
            table = through(codes)
            cost = tuple(min(table[k][after] + cost[after] for after in range(4)) for k in range(4))

    def walked(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, section, chunk, codes, come, go, last in rows:
            table = through(codes)
            whole = [come[k] + min(table[k][after] + go[after] for after in range(4)) for k in range(4)]
            best = min(whole)
            found = [walk(codes, tuple(go), k, last) if whole[k] == best else (None, None) for k in range(4)]
            yield conv, section, chunk, [f[0] for f in found], [f[1] for f in found], best

    def chosen(rows: Iterator[tuple]) -> Iterator[tuple]:
        now, role = object(), 0
        for conv, section, chunk, audits, after, best in rows:
            if conv != now:
                now, role = conv, 0
            yield conv, section, chunk, role, audits[role], best
            role = after[role]

    dealt = chunks.select("conv_id", "section", "chunk", "codes").repartition(width, "conv_id")
    costs = _streamed(_by_conversation(_streamed(_by_conversation(dealt), forward, f"{key}, come array<bigint>"), True), backward, f"{key}, come array<bigint>, go array<bigint>, last boolean")
    paths = _streamed(costs.repartition(width, "section", "chunk"), walked, f"conv_id {kind}, section int, chunk bigint, audits array<string>, after array<int>, best bigint")
    return _streamed(_by_conversation(paths.repartition(width, "conv_id")), chosen, f"conv_id {kind}, section int, chunk bigint, before int, audit string, cost bigint")


def _plan(rows: DataFrame, chunk_rows: int) -> tuple[DataFrame, DataFrame]:
    """Chunks with their counts and audits, and the turns of the repaired conversations."""
    ordered = materialise(_ordered(rows, chunk_rows), "structure-rows")
    chunks = ordered.where("place = -1").drop("place", "role", "text")
    audits = materialise(_audited(chunks), "structure-audits")
    kind = rows.schema["conv_id"].dataType.simpleString()

    def applied(rows: Iterator[tuple]) -> Iterator[tuple]:
        letters, role, at, out = "", 0, 0, 0

        def pending(until: int | None) -> Iterator[tuple]:
            # edits before the row at this place among the codes: deletions and inserts
            nonlocal letters, role, at, out
            used = 0
            for letter in letters:
                if letter != "I" and at == until:
                    break
                used += 1
                if letter == "I":
                    role = NEXT[role]
                    yield out, ROLES[role], "", "I"
                    out += 1
                else:
                    at += 1
            letters = letters[used:]

        held: tuple = ()
        for conv, section, chunk, place, own, text, before, audit in rows:
            if place == -1:
                yield from ((*held, *p) for p in pending(None))
                held, letters, role, at, out = (conv, section, chunk), audit, before, 0, 0
                continue
            yield from ((*held, *p) for p in pending(place))
            letter, letters, at = letters[0], letters[1:], at + 1
            if letter != "D":
                role = _INITIALS[own[0]] if letter == "K" else NEXT[role]
                yield *held, out, own if letter == "K" else ROLES[role], text, letter
                out += 1
        yield from ((*held, *p) for p in pending(None))

    marks = audits.select("conv_id", "section", "chunk", F.lit(-1).cast("bigint").alias("place"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "before", "audit")
    own = ordered.where("place >= 0").select("conv_id", "section", "chunk", "place", "role", "text", F.lit(None).cast("int").alias("before"), F.lit(None).cast("string").alias("audit"))
    dealt = own.unionByName(marks).repartition(shuffle_width(rows.sparkSession), "section", "chunk").sortWithinPartitions("section", "chunk", "place")
    turns = _streamed(dealt, applied, f"conv_id {kind}, section int, chunk bigint, place bigint, role string, text string, edit string")
    return chunks.drop("codes").join(audits.drop("conv_id"), ["section", "chunk"]), turns


def repaired(rows: DataFrame, chunk_rows: int = CHUNK) -> DataFrame:
    """``conv_id, section, chunk, place, role, text, edit``: turns of the repaired conversations, in the order of the three numbers.

    ``rows``: ``conv_id, turn, role, text, copies``. A conversation's rows are taken by
    turn, nulls first, then by role and text; null roles and texts are one space;
    rows without an id are one conversation. Rows of any number may be equal.
    """
    return _plan(rows, chunk_rows)[1]


def repair_report(rows: DataFrame, ids: DataFrame, chunk_rows: int = CHUNK) -> DataFrame:
    """A row for each ``conv_id`` of ``ids``: faults, the cheapest edits and a digest of the repaired turns.

    ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256``. A conversation without rows has zeros, an empty audit and
    the digest of nothing. ``gaps`` is at most what a long holds.
    """
    chunks, turns = _plan(rows, chunk_rows)
    kind = rows.schema["conv_id"].dataType.simpleString()
    counts = ["blank", "duplicate", "truncated", "illegal", "first", "last", "lo", "hi", "turns", "cost", "audit"]
    empty = {"blank": "bigint", "duplicate": "bigint", "truncated": "bigint", "illegal": "bigint", "first": "string", "last": "string", "lo": "bigint", "hi": "bigint", "turns": "bigint", "cost": "bigint", "audit": "string", "role": "string", "text": "string"}
    keys = ["conv_id", "section", "chunk", "place"]
    marked = ids.select("conv_id").distinct().select("conv_id", F.lit(-1).alias("section"), F.lit(-1).cast("bigint").alias("chunk"), F.lit(-2).cast("bigint").alias("place"), *[F.lit(None).cast(t).alias(c) for c, t in empty.items()])
    told = chunks.select("conv_id", "section", "chunk", F.lit(-1).cast("bigint").alias("place"), *counts, *[F.lit(None).cast("string").alias(c) for c in ("role", "text")])
    said = turns.select(*keys, *[F.lit(None).cast(empty[c]).alias(c) for c in counts], "role", "text")

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        now, begun = None, False
        for conv, section, _, place, blank, again, cut, illegal, first, last, lo, hi, n, cost, audit, role, text in rows:
            if not begun or conv != now:
                if begun:
                    yield done()
                now, begun = conv, True
                sums, audits, digest, turned, ends, least, most, seen = [0] * 4, [], hashlib.sha256(), False, None, None, None, 0
                paid = 0

                def done() -> tuple:
                    gaps = min(most - least + 1 - seen, (1 << 63) - 1) if seen else 0
                    return now, gaps, *sums, paid, "".join(audits), digest.hexdigest()

            if place >= 0:
                digest.update((("\n" if turned else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                turned = True
            elif section >= 0:
                sums = [a + b for a, b in zip(sums, (blank, again, cut, illegal))]
                sums[3] += ends is not None and ends + first not in _LEGAL
                ends, paid = last, cost
                audits.append(audit)
                if lo is not None:
                    seen += n - (most == lo)
                    least, most = lo if least is None else least, hi
        if begun:
            yield done()

    dealt = marked.unionByName(told).unionByName(said).repartition(shuffle_width(rows.sparkSession), "conv_id").sortWithinPartitions(*keys)
    return _streamed(dealt, run, f"conv_id {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string")


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair_report(damage(rows), rows)
