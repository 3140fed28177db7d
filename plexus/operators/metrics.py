"""Detection metrics and test statistics as aggregates and windows.

Rank metrics first collapse the rows to one per distinct score, so the ordered part is as long as
the scores are distinct and ties are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plexus.operators.sorting import running_sums


def _by_score(rows: DataFrame, score: str, label: str) -> DataFrame:
    return rows.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("n"))


def auroc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve, a tie counting half; 0.5 if a class is empty."""
    won = running_sums(_by_score(rows, score, label), [F.col("s")], {"under": "n"}, inclusive=False)
    sums = won.agg(F.sum(F.col("p") * F.col("under") + F.col("p") * F.col("n") / 2).alias("u"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return sums.select(F.round(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u") / F.col("p") / F.col("n")).otherwise(0.5), 6).alias("auroc"))


def best_f1(rows: DataFrame, score: str, label: str) -> DataFrame:
    """``(best_f1, threshold)`` over all thresholds, higher scores predicted positive; ties to the lower threshold."""
    total = rows.agg(F.sum(F.col(label).cast("long")).alias("all"))
    runs = running_sums(_by_score(rows, score, label), [F.desc("s")], {"tp": "p", "fp": "n"}).crossJoin(F.broadcast(total))
    f1 = F.round(F.col("tp") * 2.0 / (F.col("tp") + F.col("fp") + F.col("all")), 6)
    return runs.select("s", f1.alias("f1")).agg(F.max(F.struct("f1", (-F.col("s")).alias("s"))).alias("b")).select(
        F.col("b.f1").alias("best_f1"), (-F.col("b.s")).alias("threshold")
    )


def confusion(rows: DataFrame, predicted: str, label: str) -> DataFrame:
    """``(tp, fp, fn, precision, recall, f1)`` of 0/1 columns."""
    count = lambda p, y: F.sum(((F.col(predicted) == p) & (F.col(label) == y)).cast("long"))
    c = rows.agg(count(1, 1).alias("tp"), count(1, 0).alias("fp"), count(0, 1).alias("fn"))
    share = lambda d: F.round(F.col("tp") / F.nullif(d, F.lit(0)), 6)
    return c.select("tp", "fp", "fn", share(F.col("tp") + F.col("fp")).alias("precision"), share(F.col("tp") + F.col("fn")).alias("recall"),
                    F.round(F.col("tp") * 2.0 / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), 6).alias("f1"))


def detection_delay(rows: DataFrame, group: str, t: str, signal: str, label: str, threshold: float) -> DataFrame:
    """``(group, bursts, detected, mean_delay)``: rows from the start of a run of positive labels to
    the first signal at or above the threshold within it, over the detected runs."""
    order = Window.partitionBy(group).orderBy(t)
    marked = rows.select(
        group, F.row_number().over(order).alias("i"), (F.col(label) == 1).alias("on"), (F.col(signal) >= threshold).alias("fired"),
        F.coalesce(F.lag(F.col(label)).over(order) == 1, F.lit(False)).alias("was"),
    )
    burst = F.sum((F.col("on") & ~F.col("was")).cast("int")).over(Window.partitionBy(group).orderBy("i"))
    runs = marked.withColumn("burst", burst).filter("on").groupBy(group, "burst").agg(
        F.min("i").alias("start"), F.min(F.when(F.col("fired"), F.col("i"))).alias("first")
    )
    return runs.groupBy(group).agg(F.count("*").alias("bursts"), F.count("first").alias("detected"), F.round(F.avg(F.col("first") - F.col("start")), 6).alias("mean_delay"))


def describe(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Per group: count, extremes, mean, sample deviation, median, variation and the half-width
    ``2.045 sd / sqrt(n)`` of a 95 % interval."""
    x = F.col(value).cast("double")
    s = rows.groupBy(group).agg(F.count(x).alias("n"), F.min(x).alias("least"), F.max(x).alias("most"), F.avg(x).alias("m"), F.stddev_samp(x).alias("sd"), F.median(x).alias("med"))
    r = lambda c: F.round(c, 6)
    return s.select(group, "n", r(F.col("least")).alias("least"), r(F.col("most")).alias("most"), r(F.col("m")).alias("mean"), r(F.col("sd")).alias("sd"),
                    r(F.col("med")).alias("median"), r(F.col("sd") / F.col("m") * 100).alias("cv"), r(F.col("sd") * 2.045 / F.sqrt("n")).alias("half_width"))


def welch(rows: DataFrame, group: str, value: str, a, b) -> DataFrame:
    """Welch's ``(t, df, p)`` of two groups.

    ``p`` is two-sided by ``z = |t| (1 - 1 / (4 df))`` and the tail ``exp(-0.717 z - 0.416 z^2)``.
    Without any variance it is 0 if the first mean is larger, else 1.
    """
    x = F.col(value).cast("double")
    part = lambda g, n: [F.count(F.when(F.col(group) == g, x)).alias(f"n{n}"), F.avg(F.when(F.col(group) == g, x)).alias(f"m{n}"),
                         F.var_samp(F.when(F.col(group) == g, x)).alias(f"v{n}")]
    s = rows.agg(*part(a, 1), *part(b, 2)).selectExpr("*", "v1 / n1 as e1", "v2 / n2 as e2")
    s = s.selectExpr("*", "(m1 - m2) / sqrt(nullif(e1 + e2, 0)) as t", "(e1 + e2) * (e1 + e2) / nullif(e1 * e1 / (n1 - 1) + e2 * e2 / (n2 - 1), 0) as df")
    z = F.abs("t") * (1 - 1 / (4 * F.col("df")))
    tail = F.when(z > 0, F.exp(-0.717 * z - 0.416 * z * z)).otherwise(1.0)
    p = F.when(F.col("t").isNull(), F.when(F.col("m1") > F.col("m2"), 0.0).otherwise(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))
    return s.select(F.round("t", 6).alias("t"), F.round("df", 6).alias("df"), F.round(p, 6).alias("p"))


def wilcoxon(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Signed-rank test ``(n, w_plus, w_minus, z)`` of ``b - a``: average ranks, correction 0.5.

    A positive ``z`` says that ``a`` is smaller; fewer than five non-zero differences give null.
    """
    d = rows.select((F.col(b) - F.col(a)).alias("d")).filter("d <> 0").groupBy(F.abs("d").alias("size")).agg(
        F.sum((F.col("d") > 0).cast("long")).alias("up"), F.sum((F.col("d") < 0).cast("long")).alias("down")
    )
    d = running_sums(d.withColumn("both", F.col("up") + F.col("down")), [F.col("size")], {"below": "both"}, inclusive=False)
    ranked = d.select("up", "down", (F.col("below") + (F.col("up") + F.col("down") + 1) / 2).alias("r"))
    s = ranked.agg(F.sum(F.col("up") + F.col("down")).alias("n"), F.sum(F.col("up") * F.col("r")).alias("w_plus"), F.sum(F.col("down") * F.col("r")).alias("w_minus"))
    # in double precision: the product leaves the longs at 1.7 million differences
    n, gap = F.col("n").cast("double"), F.col("w_plus") - F.col("w_minus")
    z = F.signum(gap) * F.greatest(F.lit(0.0), F.abs(gap) / 2 - 0.5) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0)
    return s.select("n", F.round("w_plus", 6).alias("w_plus"), F.round("w_minus", 6).alias("w_minus"), F.round(F.when(n >= 5, z), 6).alias("z"))


def agreement(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``(n, share)``: rows that both hold by key, and the share of equal values."""
    both = a.select(*keys, F.col(value).alias("x")).join(b.select(*keys, F.col(value).alias("y")), keys)
    return both.agg(F.count("*").alias("n"), F.round(F.avg(F.col("x").eqNullSafe(F.col("y")).cast("double")), 6).alias("share"))


def bootstrap_auroc(rows: DataFrame, key: str, score: str, label: str, draws: int = 30, size: int = 4000) -> DataFrame:
    """``(draw, auroc)`` over ``draws`` subsamples of ``size`` rows, each the smallest digests of its draw."""
    out = None
    for k in range(draws):
        some = rows.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(k)))), key).limit(size)
        one = auroc(some, score, label).select(F.lit(k).alias("draw"), "auroc")
        out = one if out is None else out.union(one)
    return out


def wins(results: DataFrame, case: str, contender: str, value: str) -> DataFrame:
    """``(contender, wins)``: cases in which a contender's value is the least; ties to the first name."""
    best = results.groupBy(case).agg(F.min(F.struct(value, contender)).alias("best"))
    return best.groupBy(F.col(f"best.{contender}").alias("contender")).agg(F.count("*").alias("wins"))


def equivalent(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float = 1e-9) -> bool:
    """Whether two results have the same keys and values within the tolerance."""
    both = a.select(*keys, F.col(value).alias("x"), F.lit(1).alias("l")).join(b.select(*keys, F.col(value).alias("y"), F.lit(1).alias("r")), keys, "full")
    return both.filter(F.col("l").isNull() | F.col("r").isNull() | (F.abs(F.col("x") - F.col("y")) > tolerance)).isEmpty()
