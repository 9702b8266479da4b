"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

Every window of ``words`` normalised words of every text is hashed by rolling
sums (numpy over Arrow batches, no shuffle) and looked up in the benchmark's
set; a hash that is found is verified word by word. The set is built in blocks
of bounded size. A benchmark beyond one block is scanned for in further passes:
what a pass found is written to the shared folder and its block destroyed before
the next one is built, so that one block at a time is held, whatever the tables' size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, prefix_hash, read_table, run_hash, text_slices

WINDOW = 10
#: characters of benchmark text in one broadcast block
BLOCK_CHARS = 2_000_000
SLICE = 1 << 21
#: word bytes are digits, letters (lower-cased) and all bytes of non-ASCII characters; others become 0
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 0 for c in range(256))


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD).replace(b"\0", b" ").split(b" ") if text else []


class GramSet:
    """Windows of one block of benchmark items."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.grams: dict[bytes, set[str]] = {}
        widths: dict[int, list[bytes]] = {}
        for item, text in items:
            words = [w for w in normal_words(text) if w]
            if not words:
                continue
            k = min(window, len(words))
            for i in range(len(words) - k + 1):
                gram = b" ".join(words[i : i + k])
                if gram not in self.grams:
                    self.grams[gram] = set()
                    widths.setdefault(k, []).append(gram)
                self.grams[gram].add(item)
        self.tables = {}
        for k, grams in widths.items():
            raw, starts, ends, hashes = _words(grams)
            first = np.searchsorted(starts, np.cumsum([0, *[len(g) + 1 for g in grams[:-1]]]))
            found = np.unique(run_hash(prefix_hash(hashes), first, first + k))
            filter_ = np.zeros(1 << 20, bool)
            filter_[found >> np.uint64(44)] = True
            self.tables[k] = (filter_, found)


def _words(texts: list[bytes]):
    """Normalised bytes of the texts (0 between words and texts), word bounds and word hashes."""
    raw = b"\0".join(texts).translate(_WORD)
    flat = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(flat) + 2, bool)
    np.not_equal(flat, 0, out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    return raw, starts, ends, run_hash(prefix_hash(flat), starts, ends)


def scan_texts(texts: list[bytes], grams: GramSet):
    """Per text: number of words, hit word runs, names of items found."""
    raw, starts, ends, hashes = _words(texts)
    bounds = np.cumsum([0, *[len(t) + 1 for t in texts]])
    doc = np.searchsorted(bounds, starts, "right") - 1
    n_words = np.bincount(doc, minlength=len(texts))
    found: list[set[str]] = [set() for _ in texts]
    runs: list[list[tuple[int, int]]] = [[] for _ in texts]
    first_word = np.cumsum(n_words) - n_words
    prefix = prefix_hash(hashes)
    for k, (filter_, known) in grams.tables.items():
        if len(starts) < k:
            continue
        at = np.arange(len(starts) - k + 1)
        h = run_hash(prefix, at, at + k)
        at = np.flatnonzero(filter_[h >> np.uint64(44)] & (doc[: len(at)] == doc[k - 1 :]))
        if not len(at):
            continue
        place = np.searchsorted(known, h[at])
        at = at[known[np.minimum(place, len(known) - 1)] == h[at]]
        for j in at.tolist():
            items = grams.grams.get(b" ".join([raw[starts[i] : ends[i]] for i in range(j, j + k)]))
            if items:
                d = int(doc[j])
                found[d] |= items
                runs[d].append((j - int(first_word[d]), j - int(first_word[d]) + k))
    return n_words, runs, found


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def block_count(items: DataFrame, block_chars: int) -> int:
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    return -(-chars // block_chars) or 1


def gram_block(items: DataFrame, blocks: int, i: int, window: int) -> GramSet:
    """Windows of the i-th of ``blocks`` parts of ``items(item, text)``."""
    part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == i)
    return GramSet([(r["item"], r["text"]) for r in part.toLocalIterator()], window)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS, keep: list[str] | None = None) -> DataFrame:
    """``id_col, n_words, runs, items`` and the columns in ``keep`` (``text_col`` itself may be one), a row for each row of ``docs``.

    ``runs`` are maximal half-open runs of hit word numbers, ``items`` the sorted
    names of the benchmark items with a window in the text. Null and empty texts
    have no words. An item shorter than a window, but not empty, is one window;
    an item without words is never found; a null item id is named ''. Repeated
    rows are judged each by itself, and columns of any other name don't matter.
    """
    spark = docs.sparkSession
    keep = keep or []
    rest = [c for c in keep if c != text_col]
    cur = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.lit(0).cast("bigint").alias("_n"), F.expr("cast(array() as array<struct<a: bigint, b: bigint>>)").alias("_runs"), F.expr("cast(array() as array<string>)").alias("_items"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(rest)])
    schema = cur.schema
    runs_type = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    entries = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("text"))
    blocks, before = block_count(entries, block_chars), None
    for i in range(blocks):
        shared = spark.sparkContext.broadcast(gram_block(entries, blocks, i, window))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                counts, runs, names = [], [], []
                for _, texts in text_slices(batch.column(1), SLICE):
                    n, r, f = scan_texts(texts, shared.value)
                    counts.append(n)
                    runs += r
                    names += f
                old_runs, old_items = batch.column(3), batch.column(4)
                for i in range(batch.num_rows):
                    if len(old_items[i]):
                        runs[i] = runs[i] + [(x["a"].as_py(), x["b"].as_py()) for x in old_runs[i]]
                        names[i] = names[i] | set(old_items[i].as_py())
                columns = [batch.column(0), batch.column(1), pa.array(np.concatenate(counts)), pa.array([[{"a": a, "b": b} for a, b in merged(r)] for r in runs], runs_type), pa.array([sorted(n) for n in names], pa.list_(pa.string())), *batch.columns[5:]]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        cur = cur.mapInArrow(run, schema)
        if i < blocks - 1:
            cur = materialise(cur, "contamination")
            shared.destroy()
            if before is not None:
                discard(before)
            before = cur
    name = {c: f"_k{i}" for i, c in enumerate(rest)} | {text_col: "_text"}
    return cur.select(F.col("_id").alias(id_col), F.col("_n").alias("n_words"), F.col("_runs").alias("runs"), F.col("_items").alias("items"), *[F.col(name[c]).alias(c) for c in keep])


def n_hit(runs) -> F.Column:
    return F.aggregate(runs, F.lit(0).cast("bigint"), lambda s, r: s + r["b"] - r["a"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows of ``docs`` that hold no benchmark window, with their columns as they were; needs no shuffle.

    Null and empty texts have no words and stay; each repeated row is judged by
    itself; an empty table, or an empty benchmark, changes nothing.
    """
    held = docs.select(F.col("doc_id").alias("_of"), "text", F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("_row"))
    kept = contamination(held, benchmark, "_of", window=window, keep=["_row", "text"]).where(F.size("runs") == 0)
    return kept.select(*[F.col("text") if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns])


def without_spans(text: str | None, runs: list[tuple[int, int]]) -> str:
    """The text without its hit words and what stands between them."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    _, starts, ends, _ = _words([raw])
    out, at = [], 0
    for a, b in runs:
        out.append(raw[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with every hit word run cut out of ``text``; other columns stay."""
    held = docs.select("doc_id", "text", F.struct(*[F.col(c) for c in docs.columns]).alias("_row"))
    found = contamination(held, benchmark, window=window, keep=["_row"])

    @F.pandas_udf("string")
    def cut(text, runs):
        return text.combine(runs, lambda t, r: t if r is None or not len(r) else without_spans(t, [(x["a"], x["b"]) for x in r]))

    return found.withColumn("_row", F.col("_row").withField("text", cut(F.col("_row.text"), F.col("runs")))).select("_row.*")


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    out = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    names = F.concat_ws(",", F.array_sort("items"))
    return out.select("doc_id", "n_words", n_hit("runs").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.size("runs") > 0).alias("contaminated"))
