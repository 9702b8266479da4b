"""Fill-in-middle: every cut equals a plain one, and every output reads back exactly."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from epochalis.llm import infill
from epochalis.llm.common import read_table

TEXTS = st.text(alphabet=st.one_of(st.sampled_from(" \t\n\r\x0b\x0c\x1c\x85 ab<>PSM"), st.characters(codec="utf-8")), max_size=60)


def plainly(text, key):
    """Cut by a list of the units themselves."""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    lo, hi = sorted(x % (len(units) + 1) for x in h[:2])
    pre, mid, suf = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(-5, 10_000))
def test_equal_to_a_plain_cut_and_read_back(text, key):
    got = infill.infilled(text, str(key))
    assert got == plainly(text, key)
    assert infill.restored(got[4], got[1]) == text
    assert list(infill.unit_ends(text))[-1:] == ([len(text)] if text else [])


def test_whole_table(spark, data):
    docs = read_table(spark, data, "documents").select("doc_id", "text")
    done = infill.fill_in_middle(docs)
    rows = done.select("*", infill.restored_text(done["output"], done["form"]).alias("back")).collect()
    assert len(rows) == docs.count() and {r["form"] for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plainly(r["text"] or "", r["doc_id"])
        assert r["back"] == (r["text"] or "") and r["output_sha256"] == hashlib.sha256(r["output"].encode()).hexdigest()


def test_odd_rows(spark):
    long = "\n".join(f"word{k} é" for k in range(200_000))
    rows = [(k, t, "mine") for k, t in enumerate([None, "", " ", "\n" * 50_000, "one", "has <P> in it", long, long])] + [(None, "no id at all", "mine"), (3, "again", "mine"), (3, "again", "mine")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, FORM string")
    out = infill.fill_in_middle(docs, rate=100)
    assert out.columns == ["doc_id", "text", "FORM", "n", "_form", "prefix_chars", "middle_chars", "output", "output_sha256"]
    got = out.select("*", infill.restored_text(out["output"], out["_form"]).alias("back")).collect()
    assert len(got) == len(rows) and all(r["back"] == (r["text"] or "") and r["FORM"] == "mine" for r in got)
    by = {r["text"]: r for r in got}
    assert by[None]["_form"] == by[""]["_form"] == by["has <P> in it"]["_form"] == "plain" and by[None]["prefix_chars"] is None
    assert by[long]["n"] == 400_000 and by["\n" * 50_000]["n"] == 1
    assert len({r["output"] for r in got if r["text"] == "again"}) == 1
    assert infill.fill_in_middle(docs.limit(0)).count() == 0
