"""Registered queries of validation: folds, rank tests with their p values, nested searches and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import statistics as S
from ..operators import validation as V
from ..scratch import written
from ..sources.tables import read
from .queries import query

CONFIGS = [{"alpha": a, "k": k} for a in (0.001, 0.1, 1.0) for k in (1, 2, 4)]


@query("""WITH a AS (SELECT c_nationkey AS n, avg(c_acctbal) AS x FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS n, avg(s_acctbal) AS y FROM supplier GROUP BY 1), d AS (SELECT round(x - y, 6) AS d FROM a JOIN b USING (n) WHERE round(x - y, 6) <> 0),
  r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r, row_number() OVER (ORDER BY abs(d)) AS k FROM d),
  w AS (SELECT count(*) AS n, coalesce(sum(r) FILTER (WHERE d > 0), 0) AS plus, coalesce(sum(r) FILTER (WHERE d < 0), 0) AS minus FROM r),
  t AS (SELECT plus, minus, n, (SELECT list((2 * r)::INT ORDER BY k) FROM r) AS twice FROM w),
  p AS (SELECT list_reduce(list_transform(twice, lambda v: [v::DOUBLE]), lambda acc, v: list_transform(range(1, len(acc) + v[1]::INT + 1), lambda i: coalesce(acc[i], 0) + CASE WHEN i > v[1] THEN coalesce(acc[i - v[1]::INT], 0) ELSE 0 END), [1.0::DOUBLE]) AS ways FROM t)
  SELECT n, plus::DOUBLE AS w_plus, minus::DOUBLE AS w_minus, round(least(1, 2 * list_sum(ways[1:(2 * least(plus, minus))::INT + 1]) / 2.0 ** n), 9) AS p FROM t, p""")
def signed_rank_p(spark, d):
    """Customers' against suppliers' mean balances by nation: rank sums and the exact p value."""
    side = lambda t, n, b, v: read(spark, d, t).groupBy(F.col(n).alias("n")).agg(F.avg(b).alias(v))
    both = side("customer", "c_nationkey", "c_acctbal", "x").join(side("supplier", "s_nationkey", "s_acctbal", "y"), "n")
    return S.signed_rank_test(both, F.round(F.col("x") - F.col("y"), 6)).withColumn("p", F.round("p", 9))


def _features(spark, d):
    """Labelled documents with four numbers each, written once: every fold and fit reads them."""
    text = F.coalesce("text", F.lit(""))
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)) / (F.length(text) + 1)
    rows = read(spark, d, "documents").join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return written(rows.select("doc_id", "source", "quality", F.log1p(F.length(text)).alias("size"), share(r"\s+").alias("blanks"), share("[0-9]").alias("digits"), share("[.!?]").alias("stops")), "features")


@query(None)
def nested_quality(spark, d):
    """Quality of documents, each by a readout whose penalty and features were chosen, and which was fitted, without its source."""
    out, _ = V.nested_search(_features(spark, d), ["size", "blanks", "digits", "stops"], "quality", "source", CONFIGS, outer=4, inner=3)
    return out.select("doc_id", "source", "fold", "config", "predicted", F.round("score", 6).alias("score"))


@query(None)
def nested_decisions(spark, d):
    """Which configuration each outer fold chose, and its accuracy inside and outside."""
    _, done = V.nested_search(_features(spark, d), ["size", "blanks", "digits", "stops"], "quality", "source", CONFIGS, outer=4, inner=3)
    return done.select("fold", "config", F.round("inner_accuracy", 6).alias("inner_accuracy"), F.round("outer_accuracy", 6).alias("outer_accuracy"))


@query(None)
def stratified_group_folds(spark, d):
    """Suppliers in five folds, none split, with nearly the same share of each return flag in each."""
    return V.stratified_folds(read(spark, d, "lineitem"), "l_suppkey", "l_returnflag", 5)


@query("""WITH s AS (SELECT 'flag ' || l_returnflag AS model, l_suppkey AS s, avg(l_quantity) AS score FROM lineitem GROUP BY 1, 2), m AS (SELECT model, avg(score) AS m FROM s GROUP BY 1),
  a AS (SELECT min_by(model, (-m, model)) AS model FROM m WHERE model IN ('flag A', 'flag R')), d AS (SELECT s.s, s.score - o.score AS d FROM s JOIN a USING (model) JOIN s o ON o.s = s.s AND o.model = 'flag N')
  SELECT (SELECT model FROM a) AS ours, 'flag N' AS theirs, round(avg(d), 6) AS lead, count(*) FILTER (WHERE round(d, 12) <> 0) AS n, avg(d) > 0 AS ahead FROM d""")
def paired_decision(spark, d):
    """The better of two return flags against the third by suppliers' mean quantities."""
    scores = read(spark, d, "lineitem").groupBy(F.concat(F.lit("flag "), "l_returnflag").alias("model"), F.col("l_suppkey").alias("s")).agg(F.avg("l_quantity").alias("score"))
    out = V.decided(scores, "s", ["flag A", "flag R"], ["flag N"])
    return out.select("ours", "theirs", F.round("lead", 6).alias("lead"), "n", (F.col("verdict") != "behind").alias("ahead"))
