"""Exact duplicates: equal to plain grouping by the normalised text, whatever the level at which texts part."""

import hashlib
import random
import re

from epochalis.llm import exact
from epochalis.llm.common import read_table

SCHEMA = "doc_id bigint, text string"


def grouped(rows):
    """By a dictionary of whole texts: doc_id -> (keep_id, size, kept, digest)."""
    groups: dict = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(doc_id)
    return {i: (min(ids), len(ids), i == min(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids}


def found(frame):
    return {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in frame.collect()}


def test_radix_classes_equal_a_dictionary():
    rng = random.Random(3)
    heads = [b"", b"x" * 63, b"x" * 64, b"x" * 65, b"x" * 320, b"y" * 5000, b"y" * 200_000]
    texts = [rng.choice(heads) + rng.choice((b"", b"a", b"b", b"\0", b"a" * 64)) for _ in range(800)]
    first: dict = {}
    assert exact.radix_classes(texts) == [first.setdefault(t, i) for i, t in enumerate(texts)]
    assert exact.radix_classes([]) == []


def test_white_space_is_ascii_white_space():
    for text in ("", " ", "\t\n", " a", "a ", "a \t\x0b\x0c\r b\n", "a\x1c\x85  b", " ", " 　 x"):
        assert exact.normalised(text.encode()) == re.sub(r"[\x20\x09-\x0D]+", " ", text).encode()


def test_whole_table_over_many_partitions(spark, data):
    docs = read_table(spark, data, "documents").select("doc_id", "text")
    twice = docs.unionByName(docs.selectExpr("doc_id + 100000 AS doc_id", "replace(text, ' ', ' \n') AS text")).repartition(7)
    want = grouped([tuple(r) for r in twice.collect()])
    assert sum(not kept for _, _, kept, _ in want.values()) >= docs.count()
    assert found(exact.exact_classes(twice)) == want


def test_large_groups_are_split_until_texts_part(spark, monkeypatch):
    """Groups too large for a task go on to digits that part them, or to their texts' end."""
    monkeypatch.setattr(exact, "GROUP_ROWS", 3)
    monkeypatch.setattr(exact, "GROUP_BYTES", 2000)
    rows = [(i, "line " * 20 + "and " * (i % 4) * 30) for i in range(60)] + [(100 + i, "z" * 1344 + "q" * (i % 3)) for i in range(30)] + [(200 + i, "short") for i in range(30)] + [(300 + i, "w" * 64) for i in range(12)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(16)
    assert found(exact.exact_classes(docs)) == grouped(rows)


def test_nulls_ties_repeats_and_clashing_names(spark):
    rows = [(5, None), (4, ""), (3, " "), (2, "\n\t "), (1, "a  b"), (7, "a\nb"), (6, "a b "), (None, "a b"), (None, "alone"), (9, "twice"), (9, "twice"), (9, "other")]
    docs = spark.createDataFrame([(*r, k, "x") for k, r in enumerate(rows)], "doc_id bigint, text string, uid int, Carried string").repartition(5)
    out = exact.exact_classes(docs, carry=("uid", "Carried")).select("doc_id", "keep_id", "group_size", "kept", "carried.uid").collect()
    by = {r["uid"]: r for r in out}
    assert len(by) == len(rows) and sum(r["kept"] for r in out) == 7
    assert [by[k]["keep_id"] for k in range(8)] == [4, 4, 2, 2, 1, 1, 6, 1]
    assert by[8]["keep_id"] is None and by[8]["kept"] and not by[7]["kept"]
    assert by[9]["kept"] + by[10]["kept"] == 1 and by[11]["kept"] and by[9]["group_size"] == 2
    stay = exact.drop_exact_duplicates(docs)
    assert stay.columns == docs.columns and stay.count() == 7
    assert exact.exact_classes(docs.limit(0)).count() == 0
