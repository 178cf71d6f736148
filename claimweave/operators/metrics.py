"""Evaluation of scores: ranking curves, confusion, correlation intervals, distances."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.operators.windows import exact_quantiles, group_quantiles, group_value_ranks, percent_ranks


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve from rank sums (ties count half); null with one class."""
    x = percent_ranks(df.where(F.col(score).isNotNull() & F.col(label).isNotNull()), score, "__cw_p")
    a = x.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("p"), F.sum(F.when(F.col(label) == 1, F.col("__cw_p"))).alias("s"))
    n, p = F.col("n"), F.col("p")
    return a.select(n.alias("n"), p.cast("long").alias("positives"), F.when((p > 0) & (p < n), (F.col("s") * n - p * (p + 1) / 2) / (p * (n - p))).alias("auc"))


def curve_at_percentiles(df: DataFrame, score: str, label: str, levels: int = 99) -> DataFrame:
    """Precision, recall, true and false positive rate at so many percentile cutoffs of the score:
    one pass of counts per slot between cutoffs, accumulated over the few slots."""
    x = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    ps = [(i + 1) / (levels + 1) for i in range(levels)]
    cuts = exact_quantiles(x, score, ps)
    spark = df.sparkSession
    if not cuts:
        return spark.createDataFrame([], "level int, cutoff double, precision double, recall double, fpr double")
    slot = reduce(Column.__add__, [(F.col(score) >= F.lit(c)).cast("int") for c in cuts])
    slots = x.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("p"))
    grid = spark.createDataFrame([(i + 1, float(c)) for i, c in enumerate(cuts)], "level int, cutoff double")
    # A row of slot s is at or above the s lowest cutoffs; the grid has `levels` rows.
    high = F.col("slot") >= F.col("level")
    a = slots.crossJoin(F.broadcast(grid)).groupBy("level", "cutoff").agg(
        F.sum(F.when(high, F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(high, F.col("p")).otherwise(0)).alias("tp"), F.sum("n").alias("all"), F.sum("p").alias("pos"))
    return a.select("level", "cutoff", F.try_divide("tp", "n").alias("precision"), F.try_divide("tp", "pos").alias("recall"), F.try_divide(F.col("n") - F.col("tp"), F.col("all") - F.col("pos")).alias("fpr"))


def first_level_below(curve: DataFrame, recall: float) -> DataFrame:
    """The first level whose recall is not above the given one, with its precision."""
    return curve.where(F.col("recall") <= recall).agg(F.min_by(F.struct("level", "precision", "recall"), "level").alias("x")).select("x.*")


def trapezoid(points: DataFrame, keys: list[str], x: str, y: str, out: str = "area") -> DataFrame:
    """Area under the points of each group, in order of x (the largest y where x repeats)."""
    p = points.groupBy(*keys, x).agg(F.max(y).alias(y))
    w = Window.partitionBy(*keys).orderBy(x)
    step = (F.lead(x).over(w) - F.col(x)) * (F.lead(y).over(w) + F.col(y)) / 2
    return p.withColumn("__cw_s", step).groupBy(*keys).agg(F.sum("__cw_s").alias(out))


def interpolate(points: DataFrame, keys: list[str], x: str, y: str, grid: list[float]) -> DataFrame:
    """Linear interpolation at the grid, extrapolated from the end segments. The grid's values are
    matched to the segment they fall in, one row per group and grid value."""
    p = points.groupBy(*keys, x).agg(F.max(y).alias(y))
    w = Window.partitionBy(*keys).orderBy(x)
    s = p.withColumn("x2", F.lead(x).over(w)).withColumn("y2", F.lead(y).over(w)).withColumn("first", F.row_number().over(w) == 1) \
        .withColumn("last", F.lead(x, 2).over(w).isNull()).where("x2 is not null")
    g = F.array(*[F.lit(v) for v in grid])
    inside = lambda v: ((v >= F.col(x)) | F.col("first")) & ((v < F.col("x2")) | F.col("last"))
    out = s.withColumn("grid", F.explode(F.filter(g, inside)))
    return out.select(*keys, "grid", (F.col(y) + (F.col("grid") - F.col(x)) * (F.col("y2") - F.col(y)) / (F.col("x2") - F.col(x))).alias("value"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def classification_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Per class precision, recall, F1 and support, with accuracy over all rows."""
    c = confusion(df, truth, predicted)
    by_t, by_p = c.groupBy("truth").agg(F.sum("n").alias("t")), c.groupBy(F.col("predicted").alias("truth")).agg(F.sum("n").alias("p"))
    hit = c.where("truth = predicted").select("truth", F.col("n").alias("h"))
    x = by_t.join(by_p, "truth", "left").join(hit, "truth", "left").na.fill(0, ["p", "h"])
    total = c.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("h")).first()
    pr, re = F.when(F.col("p") > 0, F.col("h") / F.col("p")).otherwise(0.0), F.col("h") / F.col("t")
    return x.select(F.col("truth").alias("cls"), pr.alias("precision"), re.alias("recall"),
                    F.when(F.col("h") > 0, 2 * pr * re / (pr + re)).otherwise(0.0).alias("f1"), F.col("t").alias("support"),
                    F.lit(total["h"] / total["n"] if total["n"] else None).cast("double").alias("accuracy"))


def fisher_interval(r: Column, n: Column, z: float = 1.959963985) -> tuple[Column, Column]:
    """Interval of a correlation by Fisher's transform; null for n <= 3."""
    half = F.when(n > 3, F.lit(z) / F.sqrt(n - 3))
    return F.tanh(F.atanh(r) - half), F.tanh(F.atanh(r) + half)


def summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, deviation, and exact 5th and 95th percentile of each group."""
    moments = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return moments.join(group_quantiles(df, keys, value, {"p05": 0.05, "p95": 0.95}), keys)


def beta_grid_distance(stats: DataFrame, bins: int = 50) -> DataFrame:
    """Distance between the Beta(k + .5, n - k + .5) density and that of all rows' mean, on bin
    midpoints: the sum of absolute differences of the two running sums over the number of bins, the
    closed form of one-dimensional transport. A batch of rows is one (rows, bins) array."""
    total = stats.agg(F.sum("k").alias("k"), F.sum("n").alias("n")).first()
    share = (total["k"] or 0) / total["n"] if total["n"] else 0.5

    @F.pandas_udf("double")
    def distance(k: pd.Series, n: pd.Series) -> pd.Series:
        x = (np.arange(bins) + 0.5) / bins

        def weights(k, n):
            logs = (k - 0.5)[:, None] * np.log(x) + (n - k - 0.5)[:, None] * np.log1p(-x)
            e = np.exp(logs - logs.max(1, keepdims=True))
            return e / e.sum(1, keepdims=True)

        k, n = k.to_numpy(float), n.to_numpy(float)
        return pd.Series(np.abs(np.cumsum(weights(k, n) - weights(share * n, n), 1)).sum(1) / bins)

    return stats.withColumn("distance", distance("k", "n"))


def ks_uniform(df: DataFrame, keys: list[str], value: str, first_of_ties: bool = True) -> DataFrame:
    """Largest distance of each group's empirical distribution from the uniform one on [0, 1]. Below a
    value that repeats the distribution is what it is before the first of the ties, or the last."""
    x = group_value_ranks(df, keys, value)
    upto, below = F.col("__cw_upto") / F.col("__cw_total"), (F.col("__cw_upto") - (F.col("__cw_n") if first_of_ties else 1)) / F.col("__cw_total")
    return x.groupBy(*keys).agg(F.max(F.greatest(F.abs(upto - F.col(value)), F.abs(F.col(value) - below))).alias("ks"), F.max("__cw_total").alias("n"))


def kl_distance(stats: DataFrame, bins: int = 50) -> DataFrame:
    """Kullback-Leibler divergence of the Beta(k + .5, n - k + .5) density from that of all rows' mean, both on
    bin midpoints; a batch of rows is one array."""
    total = stats.agg(F.sum("k").alias("k"), F.sum("n").alias("n")).first()
    share = (total["k"] or 0) / total["n"] if total["n"] else 0.5

    @F.pandas_udf("double")
    def divergence(k: pd.Series, n: pd.Series) -> pd.Series:
        x = (np.arange(bins) + 0.5) / bins

        def logs(k, n):
            e = (k - 0.5)[:, None] * np.log(x) + (n - k - 0.5)[:, None] * np.log1p(-x)
            e -= e.max(1, keepdims=True)
            return e - np.log(np.exp(e).sum(1, keepdims=True))

        k, n = k.to_numpy(float), n.to_numpy(float)
        p, q = logs(k, n), logs(share * n, n)
        return pd.Series((np.exp(p) * (p - q)).sum(1))

    return stats.withColumn("kl", divergence("k", "n"))


def scalar_metrics(report: DataFrame, level: str, name: str, value: str) -> DataFrame:
    """Mean of each metric per level, to four digits."""
    return report.groupBy(level, name).agg(F.round(F.avg(value) + 1e-9, 4).alias("mean"))


def pick_good_run(reports: DataFrame, run: str, metrics: list[str]) -> int | None:
    """The lowest of the runs that are best in one of the metrics (the first on ties); None without runs."""
    row = reports.agg(*[F.max_by(run, F.struct(F.col(m), -F.col(run))).alias(m) for m in metrics]).first()
    best = [row[m] for m in metrics if row[m] is not None]
    return min(best) if best else None


def probability_entropy(df: DataFrame, column: str) -> DataFrame:
    """Sum and mean of the binary entropy of probabilities; 0 and 1 have none."""
    from claimweave.functions.math import binary_entropy

    return df.agg(F.sum(binary_entropy(F.col(column))).alias("entropy"), F.avg(binary_entropy(F.col(column))).alias("mean_entropy"))
