"""Each pipeline stage on what the one before kept, against plain loops."""

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from epochalis.llm import secrets, toxicity
from epochalis.llm.queries import ORACLE_SQL


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    done = {}
    cur = docs
    for name, stage in corpus_pipeline.STAGES:
        done[name] = (cur, out := stage(spark, cur, data).cache())
        if name != "packing":
            assert out.columns == docs.columns
        cur = out
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    before, after = done["toxicity"]
    scores = toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{data}/labels.parquet")))
    assert ids(after) == ids(scores.where("score < 0.5"))
    before, after = done["near_duplicates"]
    sets = {r["doc_id"]: shingles(r["text"]) for r in before.collect()}
    label = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and label[i] != label[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                lo, hi = sorted((label[i], label[j]))
                label = {k: lo if v == hi else v for k, v in label.items()}
    assert ids(after) == set(label.values())
    before, after = done["decontamination"]
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    clean = {r[0] for r in con.execute(f"SELECT doc_id FROM ({ORACLE_SQL['op8_decontamination']}) WHERE NOT contaminated").fetchall()}
    assert ids(after) == ids(before) & clean
    before, after = done["secrets"]
    assert ids(after) == ids(before)
    found = secrets.findings(before, secrets.default_rule(spark)).where("is_secret").groupBy("doc_id").agg(F.collect_list("value").alias("values"))
    text = {r["doc_id"]: r["text"] for r in after.collect()}
    hit = {r["doc_id"]: r["values"] for r in found.collect()}
    old = {r["doc_id"]: r["text"] for r in before.collect()}
    assert all(text[i] == old[i] for i in text if i not in hit) and all(text[i].count("[SECRET]") >= len(v) for i, v in hit.items())
    before, after = done["packing"]
    pieces = after.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("whole")).collect()
    assert {r["doc_id"] for r in pieces} == ids(before) and all(r["n"] == r["whole"] for r in pieces)
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_empty_and_odd_rows(spark, data):
    kind = "doc_id long, text string, lang string, source string, n_chars long, id long, _cands string, _word string"
    rows = [(1, None, "en", "s", 0, 5, "c", "w"), (None, "no id " * 9, "en", "s", 0, 5, "c", "w"), (2, "same text " * 9, "en", "s", 0, 5, "c", "w"), (2, "same text " * 9, "en", "s", 0, 5, "c", "w"), (3, "same text " * 9, "en", "s", 0, 5, "c", "w"), (4, "", None, None, None, None, None, None)]
    for some, left in ((rows, 5), ([], 0)):
        cur = spark.createDataFrame(some, kind)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            cur = stage(spark, cur, data).cache()
            assert cur.columns == [c.split()[0] for c in kind.split(", ")]
        # the copy goes, null and empty texts are one class
        assert cur.count() == (left - 1 if some else 0)
