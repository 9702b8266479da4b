"""Fill-in-middle: a text is cut into prefix, middle and suffix at unit borders and written in another order.

Arrow batches go through a pandas UDF. Ends of units, found by one expression,
are kept as an array of offsets, so that two lookups give both cuts, whatever the
number of units. Cuts and forms follow from a seed and the id alone: a text is
formatted alike wherever it stands.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import free_names, read_table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_UNIT = regex.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def unit_ends(text: str) -> array:
    """Offsets (code points) at which the units of a text end."""
    return array("Q", (m.end() for m in _UNIT.finditer(text)))


def draws(seed: int, key: str) -> tuple[int, ...]:
    """Four 32-bit numbers that follow from seed and key."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))


def infilled(text: str, key: str, seed: int = 42, rate: int = 50, spm: int = 80) -> tuple[int, str, int | None, int | None, str]:
    """Number of units, form, characters of prefix and middle (none if plain) and the text in its new order."""
    ends = unit_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = draws(seed, key)
    if not text or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (lo, hi))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", a, b - a, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def restored(output: str, form: str) -> str:
    """The text that an output was made from. No part holds a mark, so each mark is found where it was put."""
    if form == "plain":
        return output
    head, _, middle = output.partition(MIDDLE)
    if form == "psm":
        prefix, _, suffix = head[len(PREFIX) :].partition(SUFFIX)
    else:
        suffix, _, prefix = head[len(SUFFIX) :].partition(PREFIX)
    return prefix + middle + suffix


def _hex(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """Adds ``n, form, prefix_chars, middle_chars, output, output_sha256``; a name that ``docs`` has is left to it and gets underscores here.

    ``rate`` of a hundred texts are cut, ``spm`` of a hundred of those are written
    suffix first. A null text is empty; empty texts and texts with a mark in them
    stay plain, with null ``prefix_chars`` and ``middle_chars``. A missing id is
    drawn for as an empty one; rows with one id and one text are formatted alike.
    """

    @pandas_udf("n bigint, form string, prefix_chars bigint, middle_chars bigint, output string, output_sha256 string")
    def cut(keys: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = [infilled(text, key, seed, rate, spm) for key, text in zip(keys, texts)]
        columns = list(zip(*rows)) if rows else [()] * 5
        return pd.DataFrame({"n": pd.Series(columns[0], dtype="int64"), "form": pd.Series(columns[1], dtype=object), "prefix_chars": pd.Series(columns[2], dtype="Int64"), "middle_chars": pd.Series(columns[3], dtype="Int64"), "output": pd.Series(columns[4], dtype=object), "output_sha256": pd.Series([_hex(t) for t in columns[4]], dtype=object)})

    fields = ["n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"]
    *names, held = free_names(docs, *fields, "infill")
    done = docs.withColumn(held, cut(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))))
    return done.select(*docs.columns, *[F.col(held)[f].alias(name) for f, name in zip(fields, names)])


def restored_text(output: Column, form: Column) -> Column:
    """The texts read back from outputs and forms."""
    return pandas_udf(lambda outs, forms: pd.Series([restored(o, f) for o, f in zip(outs, forms)], dtype=object), "string")(output, form)


def restored_sha256(output: Column, form: Column) -> Column:
    """Digests of the texts read back."""
    return pandas_udf(lambda outs, forms: pd.Series([_hex(restored(o, f)) for o, f in zip(outs, forms)], dtype=object), "string")(output, form)


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    done = fill_in_middle(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", restored_sha256(F.col("output"), F.col("form")).alias("restored_sha256"))
