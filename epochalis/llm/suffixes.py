"""Exact removal of repeated byte strings by suffix arrays.

1. Every window of LENGTH bytes has an anchor: the least hash of the GRAM-byte
   strings in it. Equal windows have equal anchors, so only windows whose anchor
   occurs twice or more, in one text or in several, can be repeats. A run of
   windows with one anchor is a segment. Of a segment, its anchor, a hash of its
   bytes and its place are shuffled, not its bytes.
2. Of the segments of an anchor, those with equal hashes collapse to the first.
   Anchors that occur once are gone now. Anchors that a bounded sample shows to
   be frequent are dealt to many tasks first and collapse in two steps; that
   changes where rows go and nothing else.
3. The first segments are cut from the texts and meet by anchor. A task sorts the
   suffixes of its segments by induced sorting: suffixes are classified,
   leftmost-smaller (LMS) substrings are sorted and named, pairs of names are
   named again while names repeat, and the array is induced from them, bucket by
   bucket in numpy. Permuted common prefixes are computed where they can't be
   derived from the place before. Suffixes that agree on LENGTH bytes are one
   window; its first occurrence is kept. An anchor with more segments than a
   task should sort is dealt anew by anchors of longer strings, up to whole
   windows, which are equal or never meet.
4. Each text loses the bytes of all its windows that aren't first occurrences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, group_starts, materialise, mixed, parted, powers, prefix_hash, read_table, shuffle_width, whole_groups
from .common import _INVERSE as INVERSE

LENGTH, GRAM = 100, 32
#: bytes of text that a worker hashes at once; windows of a segment at most
SLICE, MOST_WINDOWS = 1 << 19, 2048
#: segments of one anchor that a task sorts; an anchor with more is dealt by strings of the next of these lengths
MOST_SEGMENTS, FINER = 8_000, (56, 80, 92, 100)
#: rows that a worker sorts at once
SORTED = 8_000
#: documents of the sample that shows frequent anchors, how many of them must share one, and the tasks such anchors are dealt to
SAMPLE_DOCS, FREQUENT, SPREAD, MOST_FREQUENT = 10_000, 100, 64, 50_000


# --- induced sorting -------------------------------------------------------


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S-type); the last one is."""
    n = len(text)
    change = np.flatnonzero(text[:-1] != text[1:])
    run = np.diff(np.concatenate(([-1], change, [n - 1])))
    return np.repeat(np.append(text[change] < text[change + 1], True), run)


def _induce(text: np.ndarray, small: np.ndarray, lms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Suffix array induced from LMS suffixes in the order given."""
    n = len(text)
    out = np.full(n, -1, np.int32)
    ends = np.cumsum(counts)
    starts = ends - counts
    chars = text[lms]
    order = np.argsort(chars, kind="stable")
    per = np.bincount(chars, minlength=len(counts))
    first = np.cumsum(per) - per
    sorted_chars = chars[order]
    out[ends[sorted_chars] - per[sorted_chars] + np.arange(len(lms)) - first[sorted_chars]] = lms[order]
    larger = ~small

    def spread(part: np.ndarray, which: np.ndarray | None, at: np.ndarray, step: int) -> None:
        """Appends the suffixes before those of ``part``, in order, to their buckets; ``at`` moves on."""
        j = part - 1
        j = j[j >= 0]
        if which is not None:
            j = j[which[j]]
        if not len(j):
            return
        c = text[j]
        if len(j) > 1:
            order = c.argsort(kind="stable")
            c, j = c[order], j[order]
        begin = np.flatnonzero(c[1:] != c[:-1])
        begin += 1
        begin = np.concatenate(([0], begin))
        size = np.empty(len(begin), np.int64)
        size[:-1] = begin[1:] - begin[:-1]
        size[-1] = len(c) - begin[-1]
        key = c[begin]
        if step > 0:
            out[np.repeat(at[key] - begin, size) + np.arange(len(c))] = j
        else:
            out[np.repeat(at[key] + begin, size) - np.arange(len(c))] = j
        at[key] += step * size

    used = np.flatnonzero(counts).tolist()
    head = starts.copy()
    for c in used:
        done = int(starts[c])
        while done < head[c]:
            part = out[done : head[c]]
            done = int(head[c])
            spread(part, larger, head, 1)
        if per[c]:
            spread(out[ends[c] - per[c] : ends[c]], None, head, 1)
    tail = ends - 1
    low = head  # the larger (L-type) suffixes of a bucket end here
    out[0] = n - 1
    for c in used[::-1]:
        done = int(ends[c]) - 1
        while done > tail[c]:
            part = out[tail[c] + 1 : done + 1][::-1]
            done = int(tail[c])
            spread(part, small, tail, -1)
        spread(out[starts[c] : low[c]][::-1] if c else out[:1], small, tail, -1)
    return out


def _names(text: np.ndarray, ordered: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """True where a sorted LMS substring differs from the one before it."""
    length = np.empty(len(text), np.int32)
    length[lms] = np.append(np.diff(lms) + 1, 1)
    a, b = ordered[:-1], ordered[1:]
    new = length[a] != length[b]
    live, k = np.flatnonzero(~new), 0
    while len(live):
        differ = text[a[live] + k] != text[b[live] + k]
        new[live[differ]] = True
        live = live[~differ]
        k += 1
        live = live[length[a[live]] > k]
    return np.concatenate(([True], new))


def _ranked(new: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names, given its places by name (``order``) and where a name is new.

    Names of pairs of neighbours, of pairs of pairs and so on are made where names
    still repeat; each is the first place of its class in the order.
    """
    n = len(order)
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(begin, size)
    open_ = np.flatnonzero(np.repeat(size > 1, size))
    k = 1
    while len(open_):
        places = order[open_]
        after = np.minimum(places + k, n - 1)
        key = rank[places] * n + rank[after]
        by = np.argsort(key, kind="stable")
        places, key = places[by], key[by]
        order[open_] = places
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))
        rank[places] = open_[first]
        alone = fresh & np.append(fresh[1:], True)
        open_ = open_[~alone]
        k *= 2
    return order


def suffix_array(text: np.ndarray, alphabet: int) -> np.ndarray:
    """Suffix array of a string that ends with its only 0."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int32)
    counts = np.bincount(text, minlength=alphabet)
    small = _types(text)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    first = _induce(text, small, lms, counts)
    if len(lms) <= 1:
        return first
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = first[is_lms[first]]
    new = _names(text, ordered, lms)
    if not new.all():
        place = np.empty(n, np.int32)
        place[lms] = np.arange(len(lms))
        ordered = lms[_ranked(new, place[ordered])]
    return _induce(text, small, ordered, counts)


def common_prefixes(raw: np.ndarray, array: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Permuted common prefixes with the suffix before in the array, none beyond ``left`` bytes.

    A place whose suffix and the one before it in the array follow equal bytes
    has one less than the place before it; only the others are compared.
    """
    n = len(array)
    before = np.full(n, -1, np.int64)
    before[array[1:]] = array[:-1]
    place = np.arange(n)
    derived = (place > 0) & (before > 0)
    derived[derived] = raw[place[derived] - 1] == raw[before[derived] - 1]
    derived[1:] &= before[:-1] >= 0
    derived[1:] &= left[:-1] > 0
    derived &= np.where(before >= 0, left[np.maximum(before, 1) - 1], 0) > 0
    own = np.flatnonzero(~derived & (before >= 0))
    out = np.zeros(n, np.int64)
    padded = np.concatenate((raw, np.zeros(16, np.uint8)))
    words = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(padded) - 7,), (1,))  # the 8 bytes from each place on
    most = np.minimum(left[own], left[before[own]])
    live, k = np.arange(len(own)), 0
    while len(live):
        differ = words[own[live] + k] ^ words[before[own[live]] + k]
        # zero bits below the lowest set one, in bytes; 8 where nothing differs
        run = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3
        out[own[live]] = np.minimum(k + run, most[live])
        live = live[(run == 8) & (most[live] > k + 8)]
        k += 8
    anchor = np.maximum.accumulate(np.where(derived, 0, place))
    out = np.where(derived, np.maximum(out[anchor] - (place - anchor), 0), out)
    return np.minimum(out, np.where(before >= 0, np.minimum(left, left[before]), 0))


def first_windows(segments: list[bytes], length: int = LENGTH) -> np.ndarray:
    """Places, in the joined segments (one byte between two), of the first of each distinct window.

    Segments are in the order of their occurrence; each has ``length`` bytes or more.
    """
    joined = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    size = np.array([len(s) for s in segments])
    starts = np.cumsum(size + 1) - size - 1
    text = np.zeros(len(joined) + 1, np.uint16)  # 16 bits: numpy sorts them by radix
    np.add(joined, np.uint16(2), out=text[:-1], dtype=np.uint16)
    text[starts + size] = 1
    array = suffix_array(text, 258)[1:]
    left = np.repeat(starts + size, size + 1) - np.arange(len(joined))
    shared = common_prefixes(joined, array, left)
    array = array[left[array] >= length]
    # between two suffixes of LENGTH bytes or more, shorter ones can't stand inside a class
    new = shared[array] < length
    new[:1] = True
    return np.minimum.reduceat(array, np.flatnonzero(new)) if len(array) else array


# --- anchors and segments --------------------------------------------------


def anchor_runs(texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """Runs of windows with one anchor, MOST_WINDOWS at most: text number, first window, end, anchor, and whether it has the anchor twice."""
    joined = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts])
    ends = np.cumsum(size)
    n = len(joined) - length + 1
    if n <= 0:
        return (*(np.zeros(0, np.int64),) * 4, np.zeros(0, bool))
    prefix = prefix_hash(joined.astype(np.uint64) + np.uint64(1))
    grams = mixed((prefix[gram:] - prefix[:-gram]) * powers(INVERSE, len(prefix) - gram)).view(np.int64)
    w = length - gram + 1
    top = np.iinfo(np.int64).max
    rows = np.concatenate((grams, np.full(-len(grams) % w + w, top))).reshape(-1, w)
    forward = np.minimum.accumulate(rows, axis=1).ravel()
    backward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(backward[:n], forward[w - 1 : w - 1 + n])
    doc = np.repeat(np.arange(len(texts)), size)[:n]
    valid = np.arange(n) + length <= ends[doc]
    change = np.flatnonzero((least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | (valid[1:] != valid[:-1])) + 1
    first = np.concatenate(([0], change))
    last = np.append(change, n)
    keep = valid[first]
    first, last = first[keep], last[keep]
    pieces = -(-(last - first) // MOST_WINDOWS)
    if len(first) and pieces.max() > 1:  # periodic texts
        k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first, last = np.repeat(first, pieces) + k * MOST_WINDOWS, np.repeat(last, pieces)
        last = np.minimum(last, first + MOST_WINDOWS)
    base = ends[doc[first]] - size[doc[first]]
    anchor, reach = least[first], last - first + w - 1
    if len(first):
        begin = np.cumsum(reach) - reach
        places = np.arange(reach.sum()) + np.repeat(first - begin, reach)
        twice = np.add.reduceat((grams[places] == np.repeat(anchor, reach)).astype(np.int64), begin) > 1
    else:
        twice = np.zeros(0, bool)
    return doc[first], first - base, last - base, anchor, twice


def _digests(texts: list[bytes], doc: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.array([xxh3_64_intdigest(texts[d][x:y]) for d, x, y in zip(doc.tolist(), a.tolist(), (b + length - 1).tolist())], np.uint64).view(np.int64)


def _pieces(column: pa.Array, length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Rows, offsets and bytes of pieces of texts, about SLICE bytes in all; a longer text is cut so that each window lies in one piece."""
    rows, offsets, held, n = [], [], [], 0
    for row, value in enumerate(column):
        raw = value.as_buffer()
        for at in range(0, max(len(raw) - length + 1, 0), SLICE):
            rows.append(row)
            offsets.append(at)
            held.append(raw[at : at + SLICE + length - 1].to_pybytes())
            n += len(held[-1])
            if n >= SLICE:
                yield rows, offsets, held
                rows, offsets, held, n = [], [], [], 0
    if held:
        yield rows, offsets, held


PLACE = ["key", "digest", "id", "v", "a", "b"]
_PLACE = "key bigint, digest bigint, id bigint, v bigint, a int, b int"


def _segments(docs: DataFrame, length: int, frequent: list[int] | None = None) -> DataFrame:
    """A row a segment: its anchor (``key``), hash and place, ``twice``, and ``spread``, -1 or the part of a frequent anchor."""
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(np.array(frequent or [], np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            ids, versions = (batch.column(c).to_numpy() for c in (0, 1))
            for row, offset, texts in _pieces(batch.column(2), length):
                doc, a, b, key, twice = anchor_runs(texts, length)
                digest = _digests(texts, doc, a, b, length)
                at, move = np.array(row)[doc], np.array(offset)[doc]
                spread = np.full(len(doc), -1, np.int32)
                if len(known):
                    some = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key
                    spread[some] = (ids[at][some] + versions[at][some]) % SPREAD
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(digest), pa.array(ids[at]), pa.array(versions[at]), pa.array((a + move).astype(np.int32)), pa.array((b + move).astype(np.int32)), pa.array(twice), pa.array(spread)], [*PLACE, "twice", "spread"])

    return docs.mapInArrow(run, f"{_PLACE}, twice boolean, spread int")


def _shared_segments(segments: DataFrame) -> DataFrame:
    """Segments whose anchor occurs more than once, or that are parts of frequent ones, with ``fresh``: the first of its bytes (in its part).

    Rows stream in the order of anchor, hash and place; what is held is one batch
    and one row, however often an anchor occurs.
    """
    dealt = segments.repartition(shuffle_width(segments.sparkSession), "key", "spread").sortWithinPartitions("key", "digest", "id", "v", "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # a lone row of the last anchor so far
        last: tuple | None = None  # the last row given out or held
        many = False  # whether the last anchor has occurred twice
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            key, digest, id_, v, a, spread = (table.column(c).to_numpy() for c in ("key", "digest", "id", "v", "a", "spread"))
            twice = table.column("twice").to_numpy()
            n = len(key)
            same_key, same = np.zeros(n, bool), np.zeros(n, bool)
            same_key[1:] = key[1:] == key[:-1]
            same[1:] = same_key[1:] & (digest[1:] == digest[:-1])
            again = np.zeros(n, bool)
            again[1:] = same[1:] & (id_[1:] == id_[:-1]) & (v[1:] == v[:-1]) & (a[1:] == a[:-1])
            carried = False
            if held is None and last is not None and last[0] == key[0]:
                carried, same[0] = many, last[1] == digest[0]
                again[0] = same[0] and last[2:] == (id_[0], v[0], a[0])
            begin = np.flatnonzero(~same_key)
            size = np.add.reduceat((~again).astype(np.int64), begin)
            group = (size > 1) | np.logical_or.reduceat(twice, begin) | (spread[begin] >= 0)
            group[0] |= carried
            keep = np.repeat(group, np.diff(np.append(begin, n))) & ~again
            many = bool(group[-1])
            last = (key[-1], digest[-1], id_[-1], v[-1], a[-1])
            held = None if many else pa.RecordBatch.from_arrays([c.chunk(0) if c.num_chunks else c for c in table.slice(int(begin[-1]), 1).combine_chunks().columns], schema=table.schema)
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks().take(at) for c in PLACE), pa.array(~same[keep]), pa.array(spread[keep] >= 0)], [*PLACE, "fresh", "parted"])

    return dealt.mapInArrow(run, f"{_PLACE}, fresh boolean, parted boolean")


def _frequent(rows: DataFrame, length: int) -> list[int]:
    """Anchors of FREQUENT or more documents of a bounded sample: a hint for dealing rows to tasks."""
    n = rows.count()
    sample = rows if n <= SAMPLE_DOCS else rows.where(F.pmod(F.xxhash64("id"), F.lit(n // SAMPLE_DOCS)) == 0)
    often = _segments(sample, length).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    return [r["key"] for r in often.orderBy(F.desc("n")).limit(MOST_FREQUENT).collect()]


# --- first windows ---------------------------------------------------------

_CUT = "key bigint, id bigint, v bigint, a int, segment binary"


def _cut(rows: DataFrame, firsts: DataFrame, length: int) -> DataFrame:
    """The bytes of ``firsts``."""
    by_doc = firsts.groupBy("id", "v").agg(F.collect_list(F.struct("key", "a", "b")).alias("hits"))  # bounded by the text
    some, _ = parted(rows, firsts, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw, found = batch.column(2)[i].as_buffer(), batch.column(3)[i].values
                a, b = found.field("a").to_numpy(), found.field("b").to_numpy()
                for lo in range(0, len(a), 1 << 14):
                    part = slice(lo, lo + (1 << 14))
                    cut = [raw[x : y + length - 1].to_pybytes() for x, y in zip(a[part].tolist(), b[part].tolist())]
                    yield pa.RecordBatch.from_arrays([found.field("key").slice(lo, len(cut)), pa.array([batch.column(0)[i].as_py()] * len(cut), pa.int64()), pa.array([batch.column(1)[i].as_py()] * len(cut), pa.int64()), pa.array(a[part]), pa.array(cut, pa.binary())], ["key", "id", "v", "a", "segment"])

    # a text that is in several rows is cut once
    once = some.dropDuplicates(["id", "v"]) if _repeats(rows) else some
    return once.select("id", "v", "raw").join(by_doc, ["id", "v"]).mapInArrow(run, _CUT)


def _finer(segments: DataFrame, length: int, gram: int) -> DataFrame:
    """``segments`` cut again at anchors of ``gram`` bytes, the first of each bytes only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, versions, place = (batch.column(c).to_numpy() for c in (1, 2, 3))
            texts = batch.column(4).to_pylist()
            doc, a, b, key, _ = anchor_runs(texts, length, gram)
            digest = _digests(texts, doc, a, b, length)
            cut = [texts[d][x:y] for d, x, y in zip(doc.tolist(), a.tolist(), (b + length - 1).tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(digest), pa.array(ids[doc]), pa.array(versions[doc]), pa.array((a + place[doc]).astype(np.int32)), pa.array(cut, pa.binary())], ["key", "digest", "id", "v", "a", "segment"])

    rows = segments.mapInArrow(run, "key bigint, digest bigint, id bigint, v bigint, a int, segment binary")
    least = rows.groupBy("key", "digest").agg(F.min(F.struct("id", "v", "a", "segment")).alias("f"))
    return materialise(least.select("key", "f.*"), "finer-segments")


def _sorted_windows(segments: DataFrame, length: int) -> DataFrame:
    """``(id, v, a, b)``: ranges of windows that are the first occurrences of their bytes."""
    dealt = segments.repartition(shuffle_width(segments.sparkSession), "key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["key"], SORTED):
            table = table.sort_by([("id", "ascending"), ("v", "ascending"), ("a", "ascending")])
            raw = table.column("segment").to_pylist()
            size = np.array([len(s) for s in raw])
            starts = np.cumsum(size + 1) - size - 1
            places = np.sort(first_windows(raw, length)).astype(np.int64)
            seg = np.searchsorted(starts, places, "right") - 1
            first = table.column("a").to_numpy()[seg] + places - starts[seg]
            new = np.flatnonzero(np.concatenate(([True], (seg[1:] != seg[:-1]) | (places[1:] != places[:-1] + 1))))[: len(seg)]
            count = np.diff(np.append(new, len(seg)))
            ids, versions = (table.column(c).to_numpy()[seg[new]] for c in ("id", "v"))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(versions), pa.array(first[new].astype(np.int32)), pa.array((first[new] + count).astype(np.int32))], ["id", "v", "a", "b"])

    return dealt.mapInArrow(run, "id bigint, v bigint, a int, b int")


def _first_windows(rows: DataFrame, firsts: DataFrame, length: int) -> DataFrame:
    """First windows of all ``firsts``; anchors with very many of them are dealt by finer anchors."""

    def large(segments: DataFrame) -> DataFrame | None:
        out = materialise(segments.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > MOST_SEGMENTS).select("key"), "large-anchors")
        return None if out.isEmpty() else out

    many = large(firsts)
    if many is None:
        return _sorted_windows(_cut(rows, firsts, length), length)
    out = _sorted_windows(_cut(rows, firsts.join(many, "key", "left_anti"), length), length)
    rest = _cut(rows, firsts.join(many, "key", "left_semi"), length)
    for gram in FINER:
        rest = _finer(rest, length, min(gram, length))
        many = large(rest) if gram < length else None
        if many is None:
            return out.unionAll(_sorted_windows(rest, length))
        out = out.unionAll(_sorted_windows(rest.join(many, "key", "left_anti"), length))
        rest = rest.join(many, "key", "left_semi").select("key", "id", "v", "a", "segment")
    raise AssertionError("the last strings are whole windows")


# --- documents -------------------------------------------------------------


def _repeats(rows: DataFrame) -> bool:
    return "twin" in rows.columns


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, v, raw, own``: documents in the order of ``(id, v)``; v is 0 unless ids repeat or are null (then last): a hash of the text."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("own"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))
    rows = rows.select(F.coalesce("own", F.lit((1 << 63) - 1)).alias("id"), F.lit(0).cast("bigint").alias("v"), "raw", "own")
    repeated = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit(True).alias("twin"))
    repeated = materialise(repeated.unionAll(rows.where("own is null").select("id", F.lit(True)).distinct()).distinct(), "repeated-ids")
    if repeated.isEmpty():
        return rows
    some, rest = parted(rows, repeated, "id")
    marked = some.join(repeated, "id", "left").withColumn("v", F.when(F.col("twin"), F.xxhash64("raw")).otherwise(F.lit(0)))
    return marked.unionAll(rest.withColumn("twin", F.lit(None).cast("boolean"))).select("id", "v", "raw", "own", "twin")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """``id_col, n_bytes, n_removed, n_spans, kept_sha256``, a row for each row of ``docs``; ``with_text`` adds ``kept`` (binary).

    Bytes go that are covered by a string of ``length`` bytes that also starts
    earlier, in the document with a smaller id or earlier in the same one. A
    null text is empty; texts under ``length`` bytes lose nothing. Ids are
    integers. Rows that repeat an id and its text are one document, and each gets
    its result; rows of one id with different texts are different documents in
    the order of a hash of the text; rows without an id come last, in that order.
    Other columns, of whatever name, don't matter; an empty table gives no rows.
    """
    rows = _documents(docs, id_col, text_col)
    plain = rows.select("id", "v", "raw")
    hits = materialise(_shared_segments(_segments(plain, length, _frequent(plain, length))), "anchor-hits")
    fresh = hits.where("fresh")
    met = fresh.where("parted").groupBy("key", "digest").agg(F.min(F.struct("id", "v", "a", "b")).alias("f")).select("key", "f.*")
    firsts = materialise(fresh.where("not parted").select("key", "id", "v", "a", "b").unionAll(met), "first-segments")
    windows = materialise(_first_windows(rows, firsts, length), "first-windows")
    discard(firsts)
    first = windows.groupBy("id", "v").agg(F.collect_list(F.struct("a", "b")).alias("first"))
    by_doc = hits.groupBy("id", "v").agg(F.collect_list(F.struct("a", "b")).alias("hits"))
    spans = by_doc.join(first, ["id", "v"], "left")
    touched, rest = parted(rows, hits, "id")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, runs, digests, kept = [], [], [], [], []
            for raw, hit, fresh in zip(batch.column(1), batch.column(2), batch.column(3)):
                raw = raw.as_buffer().to_pybytes()
                n = len(raw)
                left, removed, count = raw, 0, 0
                if hit.is_valid and n >= length:
                    again = np.zeros(n + 1, bool)
                    for a, b in zip(hit.values.field("a").to_numpy().tolist(), hit.values.field("b").to_numpy().tolist()):
                        again[a:b] = True
                    if fresh.is_valid:
                        for a, b in zip(fresh.values.field("a").to_numpy().tolist(), fresh.values.field("b").to_numpy().tolist()):
                            again[a:b] = False
                    edge = np.flatnonzero(again[1:] != again[:-1]) + 1
                    edge = np.concatenate(([0], edge)) if again[0] else edge
                    step = np.zeros(n + length + 1, np.int32)
                    np.add.at(step, edge[::2], 1)
                    np.add.at(step, edge[1::2] + length - 1, -1)
                    cover = np.cumsum(step[:n], dtype=np.int32) > 0
                    removed = int(cover.sum())
                    count = int(cover[0]) + int((cover[1:] & ~cover[:-1]).sum())
                    left = np.frombuffer(raw, np.uint8)[~cover].tobytes()
                sizes.append(n)
                gone.append(removed)
                runs.append(count)
                digests.append(hashlib.sha256(left).hexdigest())
                if with_text:
                    kept.append(left)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, gone, runs)), pa.array(digests, pa.string()), *([pa.array(kept, pa.binary())] if with_text else [])], names)

    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
    schema = f"`{id_col}` bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text
    found = touched.join(spans, ["id", "v"], "left").select("own", "raw", "hits", "first")
    none = rest.select("own", "raw", *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("hits", "first")])
    return found.mapInArrow(finish, schema).unionAll(none.mapInArrow(finish, schema))


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"))
