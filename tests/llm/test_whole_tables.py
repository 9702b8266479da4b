"""Queries over whole tables against DuckDB's SQL or plain loops."""

import glob
import hashlib
import os

import duckdb
import pyarrow.parquet as pq
import pytest
from xxhash import xxh64_intdigest

from epochalis.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, data, name):
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = con.execute(ORACLE_SQL[name])
    names = sorted(c[0] for c in want.description)
    rows = sorted(want.df()[names].astype(str).itertuples(index=False, name=None))
    got = QUERIES[name](spark, data)
    assert sorted(got.columns) == names
    assert sorted(got.select(*names).toPandas().astype(str).itertuples(index=False, name=None)) == rows


def texts_of(data):
    t = pq.read_table(f"{data}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return sorted(zip(t["doc_id"], t["text"]))


def plain_repeats(texts, length=100):
    """The windows of all texts in order, a set of those seen, and a mark for each byte."""
    seen, out = set(), {}
    for i, t in texts:
        raw = (t or "").encode()
        mark = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            w = raw[k : k + length]
            if w in seen:
                mark[k : k + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, m in zip(raw, mark) if not m)
        out[i] = (len(raw), sum(mark), sum(1 for a, b in zip(b"\0" + bytes(mark), mark) if b and not a), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats(spark, data, tmp_path):
    want = plain_repeats(texts_of(data))
    got = QUERIES["op5_suffix_dedup"](spark, data)
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want
    docs = spark.read.parquet(f"{data}/documents.parquet")
    docs.unionAll(docs).write.parquet(str(tmp_path / "documents.parquet"))
    twice = [(r[0], tuple(r)[1:]) for r in QUERIES["op5_suffix_dedup"](spark, str(tmp_path)).collect()]
    assert len(twice) == 2 * len(want) and all(want[i] == x for i, x in twice)


def test_fingerprints_and_classes(spark, data):
    marks = {}
    for i, t in texts_of(data):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            words = words.replace(c, " ")
        words = [w for w in words.split(" ") if w]
        grams = [" ".join(words[k : k + 4]) for k in range(max(len(words) - 3, 1))] if words else []
        h = [xxh64_intdigest(g.encode(), 42) for g in grams]
        marks[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
    label = {i: i for i in marks}
    for i in marks:
        for j in marks:
            if j < i and label[i] != label[j] and (marks[i] ^ marks[j]).bit_count() <= 4:
                lo, hi = sorted((label[i], label[j]))
                label = {k: lo if v == hi else v for k, v in label.items()}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op7_simhash_near_dedup"](spark, data).collect()}
    assert got == {i: (f"{marks[i]:016x}", label[i]) for i in marks}
