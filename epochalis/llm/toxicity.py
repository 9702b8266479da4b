"""Toxicity by weak supervision.

1. From a bounded sample of labelled training rows, words and word beginnings
   that toxic texts hold more often than others are counted by Spark and kept
   where the excess is clear; they are dealt into lexicon voters, which speak
   from a density of hits on, beside pattern voters (shouting, marks).
2. A generative label model (a latent class; the given label is one more voter)
   starts from the lexicons' majority and estimates by EM how often each voter
   speaks in either class, the label too, and from what is left unexplained how
   far voters repeat each other; correlated voters count for less. It gives each
   sample row a posterior probability.
3. A linear classifier on counts of the kept words, trained on the posteriors,
   scores every text whole, in one pass without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, read_table

#: the most labelled rows of each class that the model is fitted on, taken in the order of a hash of the id
MAX_TOXIC, MAX_CLEAN = 6_000, 12_000
MAX_FEATURES = 6_000
#: least standard errors by which a word must favour toxic texts
LEAST_Z = 2.4
GROUPS = 8
_WORD = re.compile(r"[^\W\d_]+")


def word_counts(text: str) -> Counter:
    return Counter(_WORD.findall(text.lower()))


def features_of(word: str) -> list[str]:
    """A word and its beginnings of 4 to 8 letters (marked by a star)."""
    return [word, *[word[:k] + "*" for k in (4, 5, 6, 7, 8) if len(word) >= k]]


def feature_counts(words: Counter, known: dict[str, int] | None = None) -> dict:
    """Occurrences of each word and beginning, and of each that occurs twice or more (a star more).

    With ``known``, only features that it names, under their numbers.
    """
    out: dict = {}
    for word, n in words.items():
        for f in features_of(word):
            if known is None or f in known:
                out[f] = out.get(f, 0) + n
    out |= {f + "*": n for f, n in out.items() if n >= 2}
    return out if known is None else {known[f]: n for f, n in out.items() if known.get(f, -1) >= 0}


def numbered(features: list[str]) -> dict[str, int]:
    """Feature -> number, and -1 for what must be counted only for the sake of its repeats."""
    out = {f: i for i, f in enumerate(features)}
    for f in features:
        if f.endswith("*"):
            out.setdefault(f[:-1], -1)
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text, toxic)`` of at most MAX_TOXIC and MAX_CLEAN labelled rows outside the held-out fifth."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = known.where(~held_out("id")).withColumn("order", F.xxhash64("id"))
    pick = [known.where(F.col("toxic") == y).orderBy("order", "id").limit(n) for y, n in ((1, MAX_TOXIC), (0, MAX_CLEAN))]
    pick = pick[0].unionAll(pick[1]).select("id", "toxic")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(pick), "id")  # at most MAX_TOXIC + MAX_CLEAN ids


def held_out(id_col: str, folds: int = 5, fold: int = 0):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def mine_features(sample: DataFrame) -> list[tuple[str, float]]:
    """Words and beginnings that mark toxic rows, with their log odds; at most MAX_FEATURES."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for text, y in zip(batch.column(0), batch.column(1)):
                seen[y.as_py()].update(feature_counts(word_counts(text.as_py())).keys())
            names = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([seen[y][f] for f in names], pa.int64()) for y in (1, 0))], ["feature", "t", "c"])

    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not totals.get(1) or not totals.get(0):
        return []
    n1, n0 = totals[1], totals[0]
    counts = sample.select("text", "toxic").mapInArrow(count, "feature string, t bigint, c bigint").groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    odds = F.log((F.col("t") + 0.5) / F.lit(n1 + 1.0)) - F.log((F.col("c") + 0.5) / F.lit(n0 + 1.0))
    error = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    found = counts.where("t >= 2").select("feature", odds.alias("odds"), (odds / error).alias("z")).where((F.col("z") >= LEAST_Z) & (F.col("odds") > 1))
    return [(r["feature"], r["odds"]) for r in found.orderBy(F.desc("z"), "feature").limit(MAX_FEATURES).collect()]


def patterns(text: str) -> list[bool]:
    """Pattern voters, over whole texts: shouting and marks."""
    letters = sum(map(str.isalpha, text)) + 1
    return [sum(map(str.isupper, text)) / letters > 0.5, "!!" in text]


def densities(rows: np.ndarray, columns: np.ndarray, counts: np.ndarray, n_words: np.ndarray, n_features: int) -> np.ndarray:
    """Hits of each lexicon (features are dealt to GROUPS by rank) in a text, for its length."""
    out = np.zeros((len(n_words), GROUPS))
    if n_features:
        np.add.at(out, (rows, columns % GROUPS), np.log1p(counts))
    return out / np.maximum(n_words, 1)[:, None] ** 0.75


def lexicon_votes(density: np.ndarray, given: np.ndarray) -> np.ndarray:
    """A lexicon speaks from the density on that, by itself, sorts the most labelled rows rightly."""
    out = np.zeros(density.shape, bool)
    for g in range(density.shape[1]):
        order = np.argsort(-density[:, g], kind="stable")
        best = int(np.cumsum(2 * given[order] - 1).argmax())
        out[:, g] = density[:, g] >= max(density[order[best], g], 1e-12)
    return out


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of each row, voter rates by class and voter weights.

    EM from the posteriors in ``start`` (a vote of the majority) alternates
    posteriors and how often each voter speaks in either class; no voter is
    trusted beforehand. A voter's weight is one over the sum of its residual
    correlations, so that voters that repeat each other share one vote.
    """
    n, m = votes.shape
    v = votes.astype(float)
    post = start.astype(float)
    weight = np.ones(m)
    rate = np.zeros((2, m))
    for _ in range(rounds):
        prior = np.clip(post.mean(), 1e-3, 1 - 1e-3)
        for y, p in ((0, 1 - post), (1, post)):
            rate[y] = (p @ v + 0.5) / (p.sum() + 1)
        left = v - np.outer(1 - post, rate[0]) - np.outer(post, rate[1])
        norm = np.sqrt((left**2).mean(0)) + 1e-6
        corr = np.abs((left.T @ left) / n / np.outer(norm, norm))
        np.fill_diagonal(corr, 1)
        weight = 1 / np.where(corr > 0.1, corr, 0).sum(0)
        odds = math.log(prior / (1 - prior)) + (v * weight) @ np.log(rate[1] / rate[0]) + ((1 - v) * weight) @ np.log((1 - rate[1]) / (1 - rate[0]))
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        moved = np.abs(new - post).max()
        post = new
        if moved < 1e-4:
            break
    return post, rate, weight


def majority(votes: np.ndarray) -> np.ndarray:
    """Posteriors to start from: what half of the lexicons or more say."""
    return np.where(2 * votes.sum(1) >= votes.shape[1], 0.9, 0.1)


def fit_linear(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, dense: np.ndarray, target: np.ndarray, n_features: int, rounds: int = 300, l2: float = 2e-5) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression on sparse counts and a few dense columns (full-batch Adam)."""
    n = len(target)
    w, u = np.zeros(n_features), np.zeros(dense.shape[1])
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(u), np.zeros_like(u)]
    for step in range(1, rounds + 1):
        z = np.bincount(rows, w[columns] * values, n) + dense @ u
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / n
        grads = (np.bincount(columns, g[rows] * values, n_features) + l2 * w, dense.T @ g)
        for i, (x, d) in enumerate(zip((w, u), grads)):
            a, b = moments[2 * i], moments[2 * i + 1]
            a += 0.1 * (d - a)
            b += 0.01 * (d * d - b)
            x -= 0.1 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-9)
    return w, u


def dense_columns(n_words: np.ndarray, n_hits: np.ndarray) -> np.ndarray:
    return np.column_stack((np.ones(len(n_words)), np.log1p(n_words) / 5, np.log1p(n_hits), np.log1p(100 * n_hits / np.maximum(n_words, 1))))


class Model:
    """Scores texts; empty ones too."""

    def __init__(self, known: dict[str, int], w: np.ndarray, u: np.ndarray, base: float):
        self.known, self.w, self.u, self.base = known, w, u, base

    def scores(self, texts: list[str]) -> np.ndarray:
        if not self.known:
            return np.full(len(texts), self.base)
        linear, n_words, n_hits = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts))
        for i, text in enumerate(texts):
            words = word_counts(text)
            counts = feature_counts(words, self.known)
            n_words[i] = sum(words.values())
            n_hits[i] = sum(counts.values())
            linear[i] = sum(self.w[k] * math.log1p(n) for k, n in counts.items())
        z = linear + dense_columns(n_words, n_hits) @ self.u
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits the model on the bounded labelled sample; without rows of both classes it predicts the share of toxic rows."""
    sample = materialise(labelled_sample(docs, labels, id_col, text_col), "toxic-sample")
    mined = mine_features(sample)
    known = numbered([f for f, _ in mined])
    if not known:
        share = sample.agg(F.avg("toxic")).first()[0] or 0.0
        return Model({}, np.zeros(0), np.zeros(4), min(max(share, 0.01), 0.49) if share < 0.5 else min(share, 0.99))
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for text, y in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                words = word_counts(text)
                counts = feature_counts(words, known)
                for column, value in zip(out, (y.as_py(), sum(words.values()), list(counts), list(counts.values()), patterns(text))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int32())), pa.array(out[3], pa.list_(pa.int32())), pa.array(out[4], pa.list_(pa.bool_()))], ["y", "n", "k", "c", "votes"])

    table = sample.select("text", "toxic").mapInArrow(vectors, "y int, n bigint, k array<int>, c array<int>, votes array<boolean>").toArrow()
    size = [len(x) for x in table["k"]]
    rows = np.repeat(np.arange(table.num_rows), size)
    columns = np.concatenate([np.asarray(x.as_py(), int) for x in table["k"]] or [np.zeros(0, int)]).astype(int)
    counts = np.concatenate([np.asarray(x.as_py(), float) for x in table["c"]] or [np.zeros(0)])
    given, n_words = table["y"].to_numpy(), table["n"].to_numpy().astype(float)
    lexicons = lexicon_votes(densities(rows, columns, counts, n_words, len(mined)), given)
    votes = np.column_stack((lexicons, np.array(table["votes"].to_pylist(), bool), given == 1))
    post, _, _ = label_model(votes, majority(lexicons))
    n_hits = np.bincount(rows, counts, table.num_rows)
    w, u = fit_linear(rows, columns, np.log1p(counts), dense_columns(n_words, n_hits), post, len(mined))
    return Model(known, w, u, 0.0)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``id_col, score`` and the columns in ``keep`` (``text_col`` itself may be one), a row for each row of ``docs``.

    Null and empty texts are scored like any text without words; texts are read
    whole; repeated rows get the same score; columns of other names don't matter.
    """
    keep = keep or []
    rest = [c for c in keep if c != text_col]
    cur = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(rest)])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    sent = [1] * (text_col in keep) + list(range(2, len(rest) + 2))  # a text goes to a worker once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = shared.value.scores([t.as_py() or "" for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got), *[batch.column(i) for i in sent]], ["_id", "_score", *[batch.schema.names[i] for i in sent]])

    schema = ", ".join(["_id " + cur.schema["_id"].dataType.simpleString(), "_score double", *[f"{f.name} {f.dataType.simpleString()}" for f in (cur.schema[i] for i in sent)]])
    out = cur.mapInArrow(run, schema)
    name = {c: f"_k{i}" for i, c in enumerate(rest)} | {text_col: "_text"}
    return out.select(F.col("_id").alias(id_col), F.col("_score").alias("score"), *[F.col(name[c]).alias(c) for c in keep])


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` that score under the threshold, with their columns as they were.

    A null or empty text is scored like any without words and stays; repeated
    rows share one verdict; an empty table stays empty; without labels of both
    classes nothing goes unless most labels are toxic.
    """
    model = fit(docs, labels)
    held = docs.select(F.col("doc_id").alias("_of"), "text", F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("_row"))
    kept = score(held, model, "_of", keep=["_row", "text"]).where(F.col("score") < threshold)
    return kept.select(*[F.col("text") if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns])


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, read_table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
