"""Validation statistics as aggregations: F test, effect size, accuracy, AUC, signed ranks, folds, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written


#: values of a group that are sorted together
WHOLE = 1024


def anova_f(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """``feature, f``: between-class over within-class variance, from one pass of sums."""
    long = df.select(label, F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("x")) for n in features])).alias("r")).select(label, "r.feature", "r.x").where("x is not null")
    by = long.groupBy("feature", label).agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    total = by.groupBy("feature").agg(F.sum("n").alias("nn"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mm"), F.count("*").alias("k"))
    sums = by.join(total, "feature").groupBy("feature").agg(F.sum(F.col("n") * (F.col("m") - F.col("mm")) * (F.col("m") - F.col("mm"))).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"), F.max("nn").alias("nn"), F.max("k").alias("k"))
    return sums.select("feature", F.try_divide(F.col("between") / F.nullif(F.col("k") - 1, F.lit(0)), F.try_divide(F.col("within"), F.col("nn") - F.col("k"))).alias("f"))


def cohens_d(df: DataFrame, value: str, label: str) -> DataFrame:
    one = lambda f, y: f(F.when(F.col(label) == y, F.col(value)))
    n1, n0 = one(F.count, 1), one(F.count, 0)
    pooled = F.sqrt(F.try_divide((n1 - 1) * one(F.var_samp, 1) + (n0 - 1) * one(F.var_samp, 0), n1 + n0 - 2))
    return df.agg(F.try_divide(one(F.avg, 1) - one(F.avg, 0), pooled).alias("d"))


def accuracy(df: DataFrame, by: list[str], y: str, pred: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col(y) == F.col(pred)).cast("int")).alias("accuracy"))


def below_in(cuts: Column, value: Column, most: int) -> Column:
    """How many of the rising ``cuts``, fewer than ``most``, are below the value: a binary search, 0 without cuts."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(most.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda b, s: b + F.when(F.get(cuts, b + s - 1) < value, s).otherwise(0))


def cumulated(df: DataFrame, value: str, *weights: str, parts: int = 256) -> DataFrame:
    """Adds ``<weight>_below``: the sum of the weight over all rows of a smaller value (distinct values, none null).

    Values are dealt to stretches between quantiles of their own, so that none holds
    more than its share whatever their scale; a stretch's offset comes from the sums
    of the few before it, and no task sorts all values. The quantiles are approximate
    and another run of them gives others, so they are written once.
    """
    cuts = written(df.agg(F.percentile_approx(value, F.array(*[F.lit(k / parts) for k in range(1, parts)]), F.lit(100 * parts)).alias("_cuts")), "cuts")
    held = df.crossJoin(F.broadcast(cuts)).withColumn("_b", below_in(F.col("_cuts"), F.col(value), parts)).drop("_cuts")  # one row
    below, inside = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    sums = held.groupBy("_b").agg(*[F.sum(w).alias(w) for w in weights]).select("_b", *[F.coalesce(F.sum(w).over(below), F.lit(0)).alias(f"_o_{w}") for w in weights])
    out = held.join(F.broadcast(sums), "_b")  # a row a stretch
    return out.select(*df.columns, *[(F.col(f"_o_{w}") + F.coalesce(F.sum(w).over(inside), F.lit(0))).alias(f"{w}_below") for w in weights])


def roc_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Rank statistic over distinct scores: counts by score first, so ties and hot scores are one row. Rows without a score don't count."""
    by = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(y) == 0, 1).otherwise(0)).alias("q"))
    wins = F.sum(F.col("p") * (F.col("q_below") + F.col("q") / 2))
    return cumulated(by, score, "q").agg(F.try_divide(wins, (F.sum("p") * F.sum("q")).cast("double")).alias("auc"))


def _signed_ranks(df: DataFrame, difference: Column) -> DataFrame:
    """``a, n, p, r``: sizes of the differences that are not 0, how many there are and are above 0, and their mean rank."""
    sizes = df.select(difference.cast("double").alias("d")).where("d <> 0 and not isnan(d)").groupBy(F.abs("d").alias("a")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, 1).otherwise(0)).alias("p"))
    return cumulated(sizes, "a", "n").select("a", "n", "p", (F.col("n_below") + (F.col("n") + 1) / 2).alias("r"))


def wilcoxon_w(df: DataFrame, difference: Column) -> DataFrame:
    """Signed-rank sums ``n, w_plus, w_minus`` of the differences that are not 0; equal sizes share their mean rank."""
    return _signed_ranks(df, difference).agg(F.sum("n").alias("n"), F.sum(F.col("p") * F.col("r")).alias("w_plus"), F.sum((F.col("n") - F.col("p")) * F.col("r")).alias("w_minus"))


def signed_rank_test(df: DataFrame, difference: Column, exact: int = 60) -> DataFrame:
    """``n, w_plus, w_minus, p``: two-sided p value of the signed-rank test.

    Up to ``exact`` differences, p comes from the number of signs that give each rank
    sum, ties included, counted by a dynamic program over the ranks; beyond that from
    the normal law with the variance of the ranks at hand, half a rank closer to its
    mean. Without differences p is 1.
    """
    ranks = _signed_ranks(df, difference)
    sums = ranks.agg(
        F.sum("n").alias("n"), F.sum(F.col("p") * F.col("r")).alias("w_plus"), F.sum((F.col("n") - F.col("p")) * F.col("r")).alias("w_minus"), (F.sum(F.col("n") * F.col("r") * F.col("r")) / 4).alias("v"),
        F.flatten(F.collect_list(F.when(F.col("n") <= exact, F.transform(F.sequence(F.lit(1), F.least("n", F.lit(exact)).cast("int")), lambda _: (2 * F.col("r")).cast("int"))))).alias("twice"),
    )
    # twice a rank is whole: a list of counts by twice the rank sum grows by one rank a step
    ways = F.aggregate("twice", F.array(F.lit(1.0)), lambda acc, r: F.zip_with(F.concat(acc, F.array_repeat(F.lit(0.0), r)), F.concat(F.array_repeat(F.lit(0.0), r), acc), lambda a, b: a + b))
    low = F.least("w_plus", "w_minus")
    tail = F.aggregate(F.slice(ways, 1, (2 * low).cast("int") + 1), F.lit(0.0), lambda a, b: a + b) / F.pow(F.lit(2.0), F.col("n"))
    z = F.greatest((F.col("w_plus") + F.col("w_minus")) / 2 - low - 0.5, F.lit(0.0)) / F.sqrt("v")
    normal = 2 * upper_tail(z)
    few = F.col("n") <= exact
    p = F.when(F.coalesce("n", F.lit(0)) == 0, 1.0).when(few, F.least(2 * tail, F.lit(1.0))).otherwise(F.least(normal, F.lit(1.0)))
    return sums.withColumn("twice", F.when(few, F.col("twice")).otherwise(F.array().cast("array<int>"))).select(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("w_plus", F.lit(0.0)).alias("w_plus"), F.coalesce("w_minus", F.lit(0.0)).alias("w_minus"), p.alias("p"))


def upper_tail(z: Column) -> Column:
    """Share of the normal law above ``z`` >= 0: its series below 3 (60 terms), its continued fraction (40 steps) beyond."""
    term = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(z.alias("t"), z.alias("s")), lambda a, k: F.struct((a["t"] * z * z / (2 * k + 1)).alias("t"), (a["s"] + a["t"] * z * z / (2 * k + 1)).alias("s")))["s"]
    density = F.exp(-z * z / 2) / F.sqrt(2 * F.pi())
    far = F.aggregate(F.sequence(F.lit(40), F.lit(1)), z, lambda a, k: z + k / a)
    return F.when(z < 3, 0.5 - density * term).otherwise(density / far)


def skill(df: DataFrame, pred: str, truth: str, last: str, mask: Column) -> Column:
    """1 - squared error of the prediction over that of persistence, where the mask holds."""
    square = lambda a: F.sum(F.when(mask, (F.col(a) - F.col(truth)) * (F.col(a) - F.col(truth))))
    return 1 - F.try_divide(square(pred), square(last))


def group_folds(df: DataFrame, group: str, label: str, folds: int) -> DataFrame:
    """Fold of each group, none split: groups in falling order of size are dealt in turns, forth and back."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n"), F.sum(F.col(label)).alias("pos"))
    place = F.row_number().over(Window.orderBy(F.desc("n"), F.desc("pos"), group)) - 1  # a row a group
    turn = F.floor(place / folds) % 2
    return sizes.withColumn("fold", F.when(turn == 0, place % folds).otherwise(folds - 1 - place % folds).cast("int"))


def counts_to_distribution(counts: DataFrame, postselect: bool = True) -> DataFrame:
    """``circuit_id, state, p, kept`` from measured bit strings (bit 0 rightmost; the leftmost register is the ancilla)."""
    bits = counts.select("circuit_id", F.regexp_replace("bits", " ", "").alias("bits"), "n")
    ok = F.substring("bits", 1, 1) == "0" if postselect else F.lit(True)
    kept = bits.groupBy("circuit_id").agg(F.sum(F.when(ok, F.col("n")).otherwise(0)).alias("kept_n"), F.sum("n").alias("all_n"))
    state = F.conv(F.expr("substring(bits, 2)") if postselect else F.col("bits"), 2, 10).cast("bigint")
    return bits.where(ok).join(kept, "circuit_id").groupBy("circuit_id", state.alias("state")).agg((F.sum("n") / F.max("kept_n")).alias("p"), (F.max("kept_n") / F.max("all_n")).alias("kept"))


def total_variation(p: DataFrame, q: DataFrame, key: list[str], state: str) -> DataFrame:
    both = p.select(*key, state, F.col("p")).unionByName(q.select(*key, state, (-F.col("p")).alias("p"))).groupBy(*key, state).agg(F.sum("p").alias("d"))
    return both.groupBy(*key).agg((F.sum(F.abs("d")) / 2).alias("tvd"))


def standardized(df: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` less their mean over their sample deviation, 0 where that is 1e-6 or less, and ``bias`` (1)."""
    stats = df.agg(*[f(c).alias(f"_{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_samp))])
    held = df.crossJoin(F.broadcast(stats))  # one row
    z = {c: F.when(F.col(f"_s_{c}") > 1e-6, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0) for c in columns}
    return held.select(*[z[c].alias(c) if c in z else F.col(c) for c in df.columns], F.lit(1.0).alias("bias"))


def exact_percentiles(df: DataFrame, group: str, value: str, shares: list[float], parts: int = 256) -> DataFrame:
    """``group, p0, p1, ...``: exact percentiles by linear interpolation, of the values that are not null.

    Values are counted in stretches between quantiles of their group; the counts show
    which few stretches hold the ranks sought, and only those are sorted, each by itself.
    The quantiles are approximate and another run of them gives others, so they are
    written once. A group of at most ``WHOLE`` values is one stretch.
    """
    kept = df.where(F.col(value).isNotNull()).select(group, F.col(value).cast("double").alias("_v"))
    cuts = kept.groupBy(F.col(group).alias("_g")).agg(F.percentile_approx("_v", F.array(*[F.lit(k / parts) for k in range(1, parts)]), F.lit(20 * parts)).alias("_cuts"), F.count("*").alias("_n"))
    cuts = written(cuts.withColumn("_cuts", F.when(F.col("_n") > WHOLE, F.col("_cuts")).otherwise(F.array().cast("array<double>"))), "cuts")
    held = kept.join(cuts, F.col(group).eqNullSafe(F.col("_g"))).withColumn("_b", below_in(F.col("_cuts"), F.col("_v"), parts)).drop("_cuts", "_g")
    counts = held.groupBy(F.col(group).alias("_g"), F.col("_b").alias("_k")).agg(F.count("*").alias("_c"), F.first("_n").alias("_m"))
    below = Window.partitionBy("_g").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)  # a row a stretch
    counts = counts.withColumn("_o", F.coalesce(F.sum("_c").over(below), F.lit(0)))
    at = lambda s: F.lit(float(s)) * (F.col("_m") - 1)
    ranks = F.array(*[f(at(s)).cast("bigint") for s in shares for f in (F.floor, F.ceil)])
    sought = counts.select("_g", "_k", "_o", "_m", F.filter(F.array_distinct(ranks), lambda r: (r >= F.col("_o")) & (r < F.col("_o") + F.col("_c"))).alias("_r")).where(F.size("_r") > 0)
    rows = held.join(sought, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_k"))).groupBy(group, "_b", "_v").agg(F.count("*").alias("_c"), F.first("_o").alias("_o"), F.first("_r").alias("_r"), F.first("_m").alias("_m"))
    inside = Window.partitionBy(group, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_s", F.col("_o") + F.coalesce(F.sum("_c").over(inside), F.lit(0)))
    hits = rows.select(group, "_m", "_v", F.explode(F.filter("_r", lambda r: (r >= F.col("_s")) & (r < F.col("_s") + F.col("_c")))).alias("_rank"))
    table = hits.groupBy(group).agg(F.first("_m").alias("_m"), F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_t"))

    def told(share: float):
        low, high = (F.element_at("_t", f(at(share)).cast("bigint")) for f in (F.floor, F.ceil))
        return low + (high - low) * (at(share) - F.floor(at(share)))

    return table.select(group, *[told(s).alias(f"p{k}") for k, s in enumerate(shares)])


def percentile_bounds(df: DataFrame, group: str, value: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """``group, low, high``: exact percentiles, interpolated."""
    return exact_percentiles(df, group, value, [low, high]).toDF(group, "low", "high")


def forecast_metrics(df: DataFrame, group: str, pred: str, truth: str, last: str) -> DataFrame:
    """``skill, corr, gain, bold``: error against persistence, correlation of the moves, the gain that matches their size, and skill under it."""
    p, y = F.col(pred) - F.col(last), F.col(truth) - F.col(last)
    moves = df.where(p.isNotNull() & y.isNotNull()).select(group, p.alias("p"), y.alias("y"))
    skill_ = 1 - F.try_divide(F.sum((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))), F.sum(F.col("y") * F.col("y")))
    first = moves.groupBy(group).agg(skill_.alias("skill"), F.corr("p", "y").alias("corr"), F.try_divide(F.stddev_samp("y"), F.stddev_samp("p")).alias("gain"))
    bold = moves.join(first.select(group, "gain"), group).withColumn("e", F.col("gain") * F.col("p") - F.col("y")).groupBy(group).agg((1 - F.try_divide(F.sum(F.col("e") * F.col("e")), F.sum(F.col("y") * F.col("y")))).alias("bold"))
    return first.join(bold, group)
